"""Files that hold one JSON array of objects each, read by many tasks.

The text reader cuts a file at every closing brace, and may begin anywhere.  Whether a
brace is inside a text, and how deep, depends on all that comes before; so each stretch
of a file is scanned once for both cases (it begins inside a text or outside), the few
stretches' results are composed in order, and the second scan, which then knows where
it begins, cuts out the objects.  An object that lies across two stretches is put
together by a small shuffle of the edges; all others stay where they were read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, BACKSLASH, OPEN, CLOSE = ord('"'), ord("\\"), (ord("{"), ord("[")), (ord("}"), ord("]"))


def scanned(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte how many unescaped quotes come before it, and what it adds to the
    depth if it is outside texts.  No piece begins behind a backslash, as none stands
    before a brace in JSON."""
    slash = data == BACKSLASH
    at = np.arange(len(data))
    run = at - np.maximum.accumulate(np.where(slash, -1, at))  # backslashes up to here
    escaped = np.append(False, run[:-1] % 2 == 1)
    quote = (data == QUOTE) & ~escaped
    depth = np.isin(data, OPEN).astype(np.int64) - np.isin(data, CLOSE)
    return np.cumsum(quote) - quote, depth


def stretches(batches: Iterator[pa.RecordBatch], *more: str) -> Iterator[tuple]:
    """(file, begin, *more, bytes) in order; a stretch may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        files, begins = batch.column("file").to_pylist(), batch.column("begin").to_pylist()
        cuts = [0, *(k for k in range(1, len(files)) if (files[k], begins[k]) != (files[k - 1], begins[k - 1])), len(files)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield files[a], begins[a], *(batch.column(c)[a].as_py() for c in more), np.frombuffer("".join(t + "}" for t in batch.column("value")[a:b].to_pylist()).encode(), np.uint8)


def composed(found: DataFrame) -> DataFrame:
    """file, begin, inside, depth, number: how each stretch begins, and how many objects
    end before it."""
    order = Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(order), F.lit(0))
    by_stretch = found.groupBy("file", "begin").agg(F.max("quotes").alias("quotes"), F.collect_list(F.struct("inside", "depth", "ends")).alias("cases"))
    out = by_stretch.withColumn("inside", before("quotes") % 2)
    own = lambda c: F.filter("cases", lambda x: x.inside == F.col("inside"))
    out = out.withColumn("own", F.get(own("cases"), F.lit(0))).withColumn("depth", before("own.depth"))
    ended = F.coalesce(F.element_at("own.ends", (1 - F.col("depth")).cast("long")), F.lit(0))
    return out.withColumn("ended", ended).select("file", "begin", "inside", "depth", before("ended").alias("number"))


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """The text of each object of the arrays in path: file, number (from 0), json."""
    lines = spark.read.text(path, lineSep="}")
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), "value")

    def surveyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for file, begin, data in stretches(batches):
            quotes, depth = scanned(data)
            seen = held.setdefault((file, begin), [0, [0, 0], [{}, {}]])
            outside = (quotes + seen[0]) % 2 == 0
            for case in (0, 1):
                own = np.where(outside == (case == 0), depth, 0)
                upto = np.cumsum(own) + seen[1][case]
                levels, n = np.unique(upto[(own < 0) & (data == CLOSE[0])], return_counts=True)
                for level, c in zip(levels.tolist(), n.tolist(), strict=True):
                    seen[2][case][level] = seen[2][case].get(level, 0) + c
                seen[1][case] = int(upto[-1])
            seen[0] += int(quotes[-1])
        rows = [(file, begin, q, case, d[case], list(ends[case].items())) for (file, begin), (q, d, ends) in held.items() for case in (0, 1)]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.map_(pa.int64(), pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["file", "begin", "quotes", "inside", "depth", "ends"])

    starts = composed(lines.mapInArrow(surveyed, "file string, begin long, quotes long, inside long, depth long, ends map<long,long>"))
    # a narrow row per stretch, so per spark.sql.files.maxPartitionBytes of input; the broadcast keeps the lines' order
    begun = lines.join(F.broadcast(starts), ["file", "begin"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, left = None, b""
        for file, begin, *start, data in stretches(batches, "inside", "depth", "number"):
            if state is None or state[:2] != (file, begin):
                if state is not None:
                    yield pieces([(state[0], state[4], state[1], True, left)])
                state, left, first = (file, begin, *start), b"", True
            _, _, inside, depth, number = state
            quotes, levels = scanned(data)
            own = np.where((quotes + inside) % 2 == 0, levels, 0)
            upto = np.cumsum(own) + depth
            ends = np.flatnonzero((own < 0) & (data == CLOSE[0]) & (upto == 1)) + 1
            text, rows, at = data.tobytes(), [], 0
            for k, end in enumerate(ends.tolist()):
                # the first of a stretch may have begun in the one before
                rows.append((file, number + k, begin, first, left + text[at:end]))
                at, left, first = end, b"", False
            left += text[at:]
            state = (file, begin, int(inside + quotes[-1]) % 2, int(upto[-1]), number + len(ends))
            if rows:
                yield pieces(rows)
        if state is not None:
            yield pieces([(state[0], state[4], state[1], True, left)])

    def pieces(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["file", "number", "begin", "edge", "text"])

    found = begun.mapInArrow(cut, "file string, number long, begin long, edge boolean, text string")
    edges = found.filter("edge").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "text"))), lambda x: x.text), "").alias("text"))
    whole = found.filter("not edge").select("file", "number", "text").unionByName(edges)
    # what is behind the last object is no object
    json = F.regexp_replace("text", r"^[\s﻿]*\[?[\s,]*", "")
    return whole.select("file", "number", json.alias("json")).filter(F.col("json").startswith("{"))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of the JSON arrays in path, of a declared schema; one file is read by as
    many tasks as its size asks for (spark.sql.files.maxPartitionBytes)."""
    return array_objects(spark, path).select(F.from_json("json", schema).alias("o")).select("o.*")
