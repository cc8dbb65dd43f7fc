"""From answer texts to scores against gold expressions."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import expressions as X
from quern.functions.columns import EXPRESSION_MARK, QUOTED, REJECTING, REJECTING_UNQUOTED, agreement_of_atoms, candidates, canonical, comparison, format_error, readings, safe_f1
from quern.session import stash

# What continues an expression over a line's end.
GOES_ON = re.compile(r"(?:&&|\|\||[=!<>]=?|[,(\[])\s*$")
CONTINUES = re.compile(r"\s*(?:&&|\|\||[,)\]])")
OPEN_END = re.compile(r"(?:&&|\|\||[=!<>]=?)\s*$")
OPEN_START = re.compile(r"\s*(?:&&|\|\||[=<>])")
JUNK = re.compile(r"\s*(?:|\*|#.*|[*_\-]{2,})\s*")
SCORES = ["strict_precision", "strict_recall", "relaxed_precision", "relaxed_recall"]


def folded(parts: list[str]) -> list[str]:
    """Neighbouring parts joined where one goes on in the next."""
    out: list[str] = []
    for part in filter(None, map(str.strip, parts)):
        if out and (GOES_ON.search(out[-1]) or CONTINUES.match(part)):
            out[-1] += " " + part
        else:
            out.append(part)
    return out


def unticked(text: str) -> str:
    text = text.strip()
    return text.strip("`").strip() or text if text[:1] == text[-1:] == "`" else text


def prose(text: str) -> bool:
    unquoted = re.sub(QUOTED, "", text)
    return not text or any(re.search(p, text) for p in REJECTING) or any(re.search(p, unquoted) for p in REJECTING_UNQUOTED) or bool(re.search(r"\s", text)) and not re.search(EXPRESSION_MARK, text)


def isolated(candidate: str) -> str | None:
    """The last clean expression of a fragment's first block of lines."""
    text = re.sub(r"\A```[^\n]*\s*\n|\n```\s*\Z", "", candidate.strip()).strip()
    block: list[str] = []
    for line in text.split("\n"):
        if not JUNK.fullmatch(line):
            block.append(line)
        elif block:
            break
    found = None
    for group in folded(re.split(r"```[^\n]*\n?|\n?```", unticked("\n".join(block)))):
        one = folded(group.split("\n"))[0]
        if not OPEN_END.search(one) and not ("\n" in group and OPEN_START.match(one)) and not prose(one):
            found = one
    return found


def first_expression(fragments: list[str]) -> tuple[int, str]:
    """(0, simplified expression) of the first fragment that has one, or (1, error)."""
    error = "parse_error: no extractable expression"
    for one in filter(None, map(isolated, fragments)):
        depth = least = 0
        for c in one:
            depth += (c == "(") - (c == ")")
            least = min(least, depth)
        if least < 0 or depth:
            error = "parse_error: mismatched parentheses" if least < 0 else "parse_error: unmatched opening parenthesis"
            continue
        if one.lower().strip("()") in X.NO_CONSTRAINT:
            return 0, ""
        try:
            return 0, X.simplified(unticked(one))
        except (ValueError, RecursionError) as e:
            text = str(e).replace("\n", " ")
            error = "parse_error: " + (text if len(text) <= 120 else text[:117] + "...")
    return 1, error


@F.pandas_udf(T.StructType([T.StructField("parse_failed", T.IntegerType()), T.StructField("expression", T.StringType())]))
def _first(fragments: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([first_expression(list(f)) for f in fragments], columns=["parse_failed", "expression"])


def extracted(answer: Column) -> Column:
    """struct<parse_failed, expression> of an answer; nothing, or a word for no constraint, is empty."""
    text = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s+|\s+$", "")
    none = (text == "") | F.lower(text).isin("none", "(none)", "true", "(true)", "false", "(false)")
    return _first(F.when(none, F.array(F.lit("none"))).otherwise(candidates(text)))


@F.pandas_udf(T.StructType([T.StructField("tree", T.StringType()), T.StructField("atoms", T.ArrayType(T.StringType())), T.StructField("parts", T.IntegerType())]))
def _read(texts: pd.Series) -> pd.DataFrame:
    """Trees over the numbers of their distinct atoms."""
    rows = []
    for text in texts:
        tree = X.tree(text)
        atoms = list(X.leaves(tree))
        rows.append([json.dumps(X.numbered(tree, {a: k for k, a in enumerate(atoms)})), atoms, len(X.members_of(tree, 1))])
    return pd.DataFrame(rows, columns=["tree", "atoms", "parts"])


@F.pandas_udf(T.StructType([T.StructField(s, T.DoubleType()) for s in SCORES]))
def _assigned(gold: pd.Series, answer: pd.Series, cells: pd.Series) -> pd.DataFrame:
    """Optimal assignment of members, layer by layer, over the atoms' agreement."""
    rows = []
    for g, a, found in zip(gold, answer, cells, strict=True):
        x, y = json.loads(g), json.loads(a)
        kinds = [{(c["i"], c["j"]): c[kind] for c in found} for kind in ("strict", "relaxed")]
        rows.append([X.agreement(x, y, by_gold, atoms) for atoms in kinds for by_gold in (False, True)])
    return pd.DataFrame(rows, columns=SCORES)


def atom_agreement(pairs: DataFrame) -> DataFrame:
    """(a, b) atoms in canonical form -> a, b, strict, relaxed.  Each distinct atom
    is taken apart once, each distinct pair compared once, all by Spark itself."""
    pairs = pairs.select("a", "b").distinct()
    atoms = pairs.select(F.col("a").alias("atom")).union(pairs.select("b")).distinct().withColumn("c", comparison(F.col("atom"))).withColumn("forms", readings(F.col("c")))
    first, second = (atoms.select(F.col("atom").alias(n), F.col("c").alias(f"c{n}"), F.col("forms").alias(f"r{n}")) for n in ("a", "b"))
    strict, relaxed = agreement_of_atoms("a", "b", "ca", "cb", "ra", "rb")
    return pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b").select("a", "b", strict.alias("strict"), relaxed.alias("relaxed"))


def compared(pairs: DataFrame, digits: int = 5) -> DataFrame:
    """(gold, answer) -> scores and sizes.  Each distinct text is read once, each
    distinct pair of atoms compared once, each distinct pair of texts matched once.

    Spark guesses a table's size from its compressed files and counts what it explodes
    as one row, so here and in evaluated() joins are named: nothing that grows with the
    answers is collected for a broadcast."""
    said = pairs.select("gold", "answer").distinct().withColumns({"x": F.coalesce("gold", F.lit("")), "y": F.coalesce("answer", F.lit(""))})
    # texts are brought into one form and read before they meet, so once each
    texts = said.select(F.col("x").alias("text")).union(said.select("y")).distinct().withColumn("t", _read(canonical(F.col("text"))))
    texts = stash(texts.select("text", "t.tree", "t.atoms", "t.parts"), "texts")
    of = lambda c, n: texts.select(F.col("text").alias(c), F.col("tree").alias(f"{n}_tree"), F.col("atoms").alias(f"{n}_atoms"), F.col("parts").alias(f"{n}_parts")).hint("merge")
    both = stash(said.join(of("x", "gold"), "x").join(of("y", "answer"), "y").drop("x", "y"), "pairs")
    cells = both.select("gold", "answer", F.posexplode("gold_atoms").alias("i", "a"), "answer_atoms").select("gold", "answer", "i", "a", F.posexplode("answer_atoms").alias("j", "b"))
    agreed = atom_agreement(cells)
    found = cells.join(agreed.hint("merge"), ["a", "b"]).groupBy("gold", "answer").agg(F.collect_list(F.struct("i", "j", "strict", "relaxed")).alias("cells"))
    none = F.array().cast("array<struct<i:int,j:int,strict:double,relaxed:double>>")
    # one side of every join is keyed by null-safe texts, as a missing gold is a gold of its own
    out = both.alias("p").join(found.alias("f").hint("merge"), F.col("p.gold").eqNullSafe(F.col("f.gold")) & F.col("p.answer").eqNullSafe(F.col("f.answer")), "left")
    out = out.select("p.*", F.coalesce("f.cells", none).alias("cells")).withColumn("s", _assigned("gold_tree", "answer_tree", "cells"))
    return out.select("gold", "answer", *(F.round(F.col(f"s.{c}"), digits).alias(c) for c in SCORES), "gold_parts", "answer_parts")


def evaluated(gold: DataFrame, answers: DataFrame, digits: int = 5) -> DataFrame:
    """gold (id, doc_constraint) joined with answers (id, text, ...): one row per
    answer with its expression and scores.  Failed parses score 0 and stay.
    Answers are extracted once per distinct text, pairs compared once each."""
    joined = answers.join(gold.select("id", F.coalesce("doc_constraint", F.lit("")).alias("doc_constraint")).hint("merge"), "id")
    texts = answers.select(F.coalesce("text", F.lit("")).alias("said")).distinct().withColumn("x", extracted(F.col("said"))).select("said", "x.parse_failed", F.col("x.expression").alias("code_constraint"))
    rows = stash(joined.join(texts.hint("merge"), F.coalesce("text", F.lit("")) == F.col("said")).drop("said"), "answers")
    read = F.col("parse_failed") == 0
    usable = F.when(read, F.col("code_constraint")).otherwise("")
    scores = stash(compared(rows.select(F.col("doc_constraint").alias("gold"), usable.alias("answer")), digits), "scores")
    out = rows.join(scores.hint("merge"), (F.col("doc_constraint") == F.col("gold")) & (usable == F.col("answer"))).drop("gold", "answer")
    out = out.withColumns({c: F.when(read, F.col(c)).otherwise(0.0) for c in SCORES} | {"answer_parts": F.when(read, F.col("answer_parts")).otherwise(0)})
    out = out.withColumnsRenamed({"gold_parts": "doc_constraint_subs", "answer_parts": "code_constraint_subs"})
    return out.withColumns({f"{m}_f1": safe_f1(F.col(f"{m}_precision"), F.col(f"{m}_recall"), digits) for m in ("strict", "relaxed")})


__all__ = ["atom_agreement", "compared", "evaluated", "extracted", "format_error"]
