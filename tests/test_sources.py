"""Arrays read by many tasks, and reports of one ordered file."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quern.jobs import evaluation
from quern.sources import arrays, tables

ODD = ['{"id": "1", "t": "a } b"}', '{"id": "2", "t": "q \\" }, { \\\\"}', '{"id": "3", "n": {"x": {"y": "]"}, "z": [1, {"w":"}"}]}}', "{}", '{"id": "ü}", "t": "line\\nbreak \\\\\\\\"}', '{"id": "5", "t": ""}']
SCHEMA = "id string, t string, n struct<x:struct<y:string>,z:array<string>>"


@pytest.mark.parametrize("size", [7, 16, 64, 100_000])
def test_arrays_of_many_stretches(spark, tmp_path, size):
    rnd = random.Random(size)
    for k in range(3):
        items = [rnd.choice(ODD) for _ in range(60)]
        (tmp_path / f"{k}.json").write_text("﻿" * (k == 1) + "[" + rnd.choice([",", ", ", ",\n  "]).join(items) + "]\n" * (k < 2) + "]" * (k == 2), encoding="utf-8")
    (tmp_path / "empty.json").write_text("[ ]")
    conf = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1"}
    before = {c: spark.conf.get(c) for c in conf}
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        found = arrays.array_objects(spark, str(tmp_path))
        rows = found.collect()
        for k in range(3):
            text = (tmp_path / f"{k}.json").read_text(encoding="utf-8-sig")
            want = json.loads(text[: text.rindex("]") + 1])
            own = sorted((r.number, r.json) for r in rows if r.file.endswith(f"/{k}.json"))
            assert [n for n, _ in own] == list(range(60)) and [json.loads(t) for _, t in own] == want
        assert len(rows) == 180
        got = arrays.read_array(spark, str(tmp_path), SCHEMA)
        plain = spark.read.schema(SCHEMA).option("multiLine", True).json([str(tmp_path / f"{k}.json") for k in range(3)])
        assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect()))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_one_line_in_many_tasks(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": str(k), "t": "{\"x\": [" * (k % 3)} for k in range(40_000)]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        rows = arrays.read_array(spark, str(tmp_path / "a.json"), "id string, t string")
        assert spark.read.text(str(tmp_path / "a.json"), lineSep="}").rdd.getNumPartitions() > 8
        assert rows.agg(F.count("*"), F.sum(F.col("id").cast("long")), F.sum(F.length("t"))).first() == (40_000, 799_980_000, 7 * sum(k % 3 for k in range(40_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_report_of_one_ordered_file(spark, tmp_path):
    rows = spark.range(500).repartition(7).select((500 - F.col("id")).alias("n"), F.when(F.col("id") % 3 == 0, 'say "hi", ü').when(F.col("id") % 3 == 1, "").alias("a b"), F.col("id").alias("order"))
    path = tmp_path / "report.csv"
    path.write_text("old")
    tables.write_report(rows, str(path), ["order"], shown=["n", "a b"])
    said = {0: '"say ""hi"", ü"', 1: "", 2: ""}
    assert path.read_bytes() == ("﻿n,a b\n" + "".join(f"{500 - k},{said[k % 3]}\n" for k in range(500))).encode()
    tables.write_report(rows.limit(0), str(path), ["order"], mark=False)
    assert path.read_bytes() == b"n,a b,order\n" and [f.name for f in tmp_path.iterdir() if not f.name.endswith(".crc")] == ["report.csv"]


def test_sections_in_order(spark, tmp_path):
    scores = [(a, m, c, str(i), float((i * (k + 1) + len(m)) % 7)) for a in ("two", "one") for m in ("relaxed", "strict") for k, c in enumerate("pqr" if a == "one" else "pq") for i in range(30)]
    df = spark.createDataFrame(scores, "analysis string, metric string, config string, id string, value double")
    report = evaluation.sectioned(evaluation.significance(df, ["analysis", "metric"]), "analysis", model="m7")
    evaluation.write_sections(report, str(tmp_path / "r.csv"), ["two", "one"])
    text = (tmp_path / "r.csv").read_bytes()
    assert text.startswith(b"\xef\xbb\xbfModel,Analysis,N,Groups,Correction,Metric,Comparison,Mean F1 (A),Mean F1 (B),Raw p-value,Corrected p-value,Significant,Cliff's Delta,Effect Size,Global chi2\n")
    cells = [line.split(",") for line in text.decode("utf-8-sig").splitlines()[1:]]
    assert [(c[0], c[1], c[5], c[6]) for c in cells] == [
        ("m7", "two", "", ""),
        ("", "", "Strict F1", "Wilcoxon signed-rank (global)"),
        ("", "", "Strict F1", "p vs q"),
        ("", "", "", ""),
        ("", "", "Relaxed F1", "Wilcoxon signed-rank (global)"),
        ("", "", "Relaxed F1", "p vs q"),
        ("", "", "", ""),
        ("m7", "one", "", ""),
        ("", "", "Strict F1", "Friedman (global)"),
        *(("", "", "Strict F1", f"{a} vs {b}") for a, b in ("pq", "pr", "qr")),
        ("", "", "", ""),
        ("", "", "Relaxed F1", "Friedman (global)"),
        *(("", "", "Relaxed F1", f"{a} vs {b}") for a, b in ("pq", "pr", "qr")),
        ("", "", "", ""),
    ]
