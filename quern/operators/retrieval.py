"""Example retrieval: most similar or random items of other projects."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.nearest import similar_items
from quern.operators.ordering import numbered
from quern.session import few, stash

__all__ = ["embedded", "example_lists", "random_items", "similar_items"]

def random_items(queries: DataFrame, items: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, project) each -> id, example_id, rank: for every query min(k, eligible)
    random items of other projects, each such set as likely as any other, in random
    order.  Repeated rows count as one; a null project is a project of its own.

    Items take positions in the order of project and a hash of seed and id, so a
    project is one stretch of a random permutation.  Of the M positions outside its
    own project's stretch a query draws k different ones (for j from M - k to M - 1 a
    number up to j, or j itself if that was drawn before, by a hash of seed, id and j)
    and meets the items there by a join on the position.  Positions come from range
    parts and their sizes, so neither a project nor the whole order is one task, and
    k rows a query are joined, however many items there are.
    """
    number = lambda *c: F.conv(F.substring(F.md5(F.concat_ws("|", *c)), 1, 15), 16, 10).cast("long")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lot = F.md5(F.concat_ws("|", F.lit(str(seed)), text("id")))
    placed = stash(numbered(items.select("id", "project").distinct().withColumn("lot", lot), [], ["project", "lot", "id"], "place").drop("lot"), "places")
    stretches = few(placed.groupBy("project").agg(F.min("place").alias("start"), F.count("*").alias("own")).withColumnRenamed("project", "of"))
    n = placed.count()
    asked = queries.select("id", "project").distinct().join(stretches, F.col("project").eqNullSafe(F.col("of")), "left")
    asked = asked.select("id", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("own", F.lit(0)).alias("own")).withColumn("others", n - F.col("own"))
    least = F.least(F.lit(k), F.col("others"))

    def draw(drawn: Column, j: Column) -> Column:
        x = F.pmod(number(F.lit(str(seed)), text("id"), j.cast("string")), j + 1)
        return F.concat(drawn, F.array(F.when(F.array_contains(drawn, x), j).otherwise(x)))

    none = F.array().cast("array<bigint>")
    drawn = F.when(least > 0, F.aggregate(F.sequence(F.col("others") - least, F.col("others") - 1), none, draw)).otherwise(none)
    lots = F.transform(drawn, lambda x: F.struct(F.md5(F.concat_ws("|", F.lit(f"{seed}"), text("id"), x.cast("string"), F.lit("order"))).alias("lot"), x.alias("x")))
    each = asked.select("id", "start", "own", F.posexplode(F.array_sort(lots)).alias("rank", "drawn"))
    x = F.col("drawn.x")
    each = each.select("id", (F.col("rank") + 1).alias("rank"), F.when(x < F.col("start"), x).otherwise(x + F.col("own")).alias("place"))
    return each.join(placed.select("place", F.col("id").alias("example_id")), "place").select("id", "example_id", "rank")


def example_lists(found: DataFrame, k: int) -> DataFrame:
    """id, example_ids: the first k, the most similar last."""
    ranked = F.sort_array(F.collect_list(F.struct("rank", "example_id")), asc=False)
    return found.filter(F.col("rank") <= k).groupBy("id").agg(F.transform(ranked, lambda x: x.example_id).alias("example_ids"))


def embedded(items: DataFrame, encode, code: Column) -> DataFrame:
    """items with an embedding of code; encode: list of texts -> array (n, d)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(encode(texts.fillna("").tolist())))

    from pyspark.sql.types import ArrayType, DoubleType

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return items.withColumn("embedding", F.pandas_udf(run, ArrayType(DoubleType()))(code))
