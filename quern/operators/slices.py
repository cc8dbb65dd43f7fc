"""Slices of methods at the granularity of statements.

A method is one row and stays one: its pieces (``statements``) become an array, and
names, risks, the statements kept and the slice are native array expressions over it.
So slices for several depths of assignments take one pass and no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.columns import ASSERTING, LITERAL, without_comments, without_empty_lines
from quern.operators.statements import CONTROLS, pieces_of, text_of, tokens_of

PLACEHOLDER = "// ..."
DEDUP = ("strict", "relaxed", "none")
#: An annotation with up to two levels of parentheses.
ANNOTATION = r"@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?"
TOKEN = r"\w+|[^\w\s]"
NAME = r"[A-Za-z_$][\w$]*"
#: What stands in parentheses, up to three levels.
NESTED = r"(?:[^()]|\((?:[^()]|\([^()]*\))*\))*"
#: Places of a statement that put names at risk; the first group holds the names.
CALLED = rf"\b({NAME})\b(?=\s*\.\s*\w)"
OF_RESULT = rf"\(({NESTED})\)\s*\.\s*\w"
INDEXED = rf"\b({NAME})\s*\[([^\[\]]+)\]"
DIVISOR = rf"[/%](?!=)\s*([\w$.]*\({NESTED}\)(?:\.[\w$.]*(?:\({NESTED}\))?)*|[\w$.]+(?:\[[^\[\]]*\])?)"
ASSIGNED = rf"({NAME})\s*(?:[-+*/%&|^]|<<|>>>?)?=(?!=)"
UPDATED = rf"(?:\+\+|--)\s*({NAME})|({NAME})\s*(?:\+\+|--)"
EACH = r"^\s*for\s*\([^;:]*:([^;]*)\)\s*$"
WHILE = r"^\s*for\s*\([^;]*;([^;]*);"


def unquoted(code: Column) -> Column:
    """Code without literals and annotations; line ends stay."""
    return F.regexp_replace(F.regexp_replace(code, LITERAL, '""'), ANNOTATION, "")


def parameters(code: Column) -> Column:
    """Names of the parameters of the first signature, in order: annotations, type
    arguments (up to four levels), arrays, varargs and modifiers are passed over."""
    plain = unquoted(without_comments(code))
    for _ in range(4):
        plain = F.regexp_replace(plain, r"<[\w\s,.?&\[\]]*>", "")
    listed = F.regexp_extract(plain, r"\w\s*\(([^()]*)\)\s*(?:throws\s[\w\s,.]+)?[{;]", 1)
    return F.filter(F.transform(F.split(listed, ","), lambda p: F.regexp_extract(p, r"(\w+)(?:\s*\[\s*\])*\s*$", 1)), lambda n: n != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"\b({NAME})\b"), 1)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def told(p: Column, tokens: Column) -> Column:
    """A piece with its text and the names at each of its places."""
    text = text_of(tokens, p)
    bare = F.regexp_replace(F.regexp_replace(text, LITERAL, '""'), ANNOTATION, "")
    return F.struct(p.alias("p"), text.alias("text"), bare.alias("bare"))


def read(e: Column) -> Column:
    all_words = lambda texts: F.array_distinct(F.flatten(F.transform(texts, words)))
    none = F.array().cast("array<string>")
    head = e.p.kind == "header"
    control = F.when(e.p.lead == "for", words(F.regexp_extract(e.bare, WHILE, 1))).when(e.p.lead.isin("if", "while", "switch"), words(e.bare)).otherwise(none)
    return F.struct(
        e.p.alias("p"),
        e.text.alias("text"),
        words(e.bare).alias("words"),
        F.array_compact(F.array(F.nullif(F.regexp_extract(e.bare, ASSIGNED, 1), F.lit("")))).alias("assigned"),
        F.array_union(found(e.bare, ASSIGNED), F.array_union(found(e.bare, UPDATED, 1), found(e.bare, UPDATED, 2))).alias("updated"),
        F.array_union(found(e.bare, CALLED), F.array_union(all_words(found(e.bare, OF_RESULT)), F.when(head, words(F.regexp_extract(e.bare, EACH, 1))).otherwise(none))).alias("called"),
        F.arrays_zip(found(e.bare, INDEXED, 1).alias("array"), F.transform(found(e.bare, INDEXED, 2), words).alias("index")).alias("indexed"),
        all_words(found(e.bare, DIVISOR)).alias("divisor"),
        control.alias("control"),
        F.exists(words(e.bare), lambda w: w.rlike(ASSERTING)).alias("asserts"),
        # what is no brace and no else, do, try or finally
        ((e.p.kind == "simple") | head & ~e.p.lead.isin("else", "do", "try", "finally")).alias("statement"),
    )


def sliced(methods: DataFrame, hops: int | Sequence[int] = 1, dedup: str = "strict") -> DataFrame:
    """id, code -> a row per method and depth: id, hop, slice, is_effective,
    is_fallback, stmt_retention, token_retention, error.

    hops: through how many assignments names are followed, one or several depths.

    A statement (or the header of a control) that puts such names at risk is a trigger:
    a throw for the names of the condition right around it, an assertion, a member or
    an element of a name, a name as index, on the right of a division or iterated over.
    dedup: strict (a trigger is kept if it brings a new pair of name and risk; throws
    and assertions always), relaxed (the first of equal ones) or none.  With a trigger
    stay the headers around it, what their else, catch or finally goes on, and earlier
    statements around it that give its names their values.  A method without trigger
    falls back to the first use of each parameter.

    Null code gives a row without slice and with an error; repeated rows are
    sliced row by row.
    """
    if dedup not in DEDUP:
        raise ValueError(f"dedup must be one of {DEDUP}")
    depths = [hops] if isinstance(hops, int) else list(hops)
    no_texts, no_numbers = F.array().cast("array<string>"), F.array().cast("array<int>")
    clean = F.regexp_replace(without_empty_lines(without_comments(F.col("code"))), r"[^\S\n]+(?=\n|$)", "")
    df = methods.select("id", "code").withColumns({"clean": clean, "tokens": tokens_of(clean), "formals": parameters(F.col("code"))})
    df = df.withColumn("pieces", pieces_of(F.col("tokens")))
    df = df.withColumn("each", F.transform("pieces", lambda p: told(p, F.col("tokens")))).withColumn("each", F.transform("each", read)).drop("tokens", "pieces")
    opening = F.array_position(F.transform("each", lambda e: (e.p.kind == "open") & (F.size(e.p.within) == 0)), True)
    df = df.withColumn("header", F.greatest(opening.cast("int") - 1, F.lit(0)))
    # a lambda's or a class's own brace makes its header a statement
    own_brace = lambda e, i: (e.p.kind == "open") & (e.p.parent == i) & (F.size(e.words) > 0)
    df = df.withColumn("each", F.transform("each", lambda e, i: e.withField("statement", (i > F.col("header")) & (e.statement | own_brace(e, i)))))

    def deciding(e: Column) -> Column:
        """Names of the condition that the statement depends on."""
        around = F.filter(e.p.within, lambda h: F.get("each", h).p.lead.isin(*CONTROLS) & (F.get("each", h).p.kind == "header"))
        nearest = F.get(around, F.size(around) - 1)
        owner = F.get(F.filter(F.get("each", nearest).p.chain, lambda h: F.get("each", h).p.lead == "if"), F.lit(0))
        return F.get("each", F.when(F.get("each", nearest).p.lead == "else", owner).otherwise(nearest)).control

    df = df.withColumn("each", F.transform("each", lambda e: e.withField("deciding", F.when(e.p.lead == "throw", F.coalesce(deciding(e), no_texts)))))
    df = df.withColumn("hop", F.explode(F.array(*map(F.lit, depths)))).withColumn("names", F.col("formals"))
    body = F.filter("each", lambda e, i: (i > F.col("header")) & (F.size(e.assigned) > 0))
    for h in range(max(depths)):
        more = F.flatten(F.transform(F.filter(body, lambda e: F.arrays_overlap(F.array_except(e.words, e.assigned), "names")), lambda e: e.assigned))
        df = df.withColumn("names", F.when(F.col("hop") > h, F.array_union("names", more)).otherwise(F.col("names")))

    def risks(e: Column) -> Column:
        known = lambda names: F.array_intersect(names, "names")
        as_pairs = lambda names, kind: F.transform(names, lambda n: F.concat_ws(":", n, F.lit(kind)))
        by_index = F.filter(e.indexed, lambda x: F.arrays_overlap(x["index"], "names"))
        plain = F.filter(e.indexed, lambda x: ~F.arrays_overlap(x["index"], "names"))
        bounds = F.flatten(F.transform(by_index, lambda x: F.array_union(x["index"], F.array(x["array"]))))
        places = [
            (F.when(e.asserts, e.words).otherwise(no_texts), "assert"),
            (bounds, "bounds"),
            (e.divisor, "math"),
            (F.array_union(e.called, F.transform(plain, lambda x: x["array"])), "npe"),
        ]
        pairs = F.concat(*(as_pairs(known(names), kind) for names, kind in places))
        return F.when(e.p.lead == "throw", as_pairs(known(F.coalesce(e.deciding, no_texts)), "throw")).otherwise(pairs)

    df = df.withColumn("triggers", F.filter(F.transform("each", lambda e, i: F.struct(i.alias("at"), F.when(e.statement, risks(e)).otherwise(no_texts).alias("pairs"), F.regexp_replace(e.text, r"^\s+", "").alias("text"))), lambda t: F.size(t.pairs) > 0))
    numbers = F.transform("triggers", lambda t: t["at"])
    if dedup == "strict":
        start = F.struct(no_texts.alias("covered"), no_numbers.alias("kept"))

        def step(state: Column, t: Column) -> Column:
            always = F.exists(t.pairs, lambda p: p.rlike(":(throw|assert)$"))
            keep = always | (F.size(F.array_except(t.pairs, state.covered)) > 0)
            return F.when(keep, F.struct(F.array_union(state.covered, t.pairs).alias("covered"), F.concat(state.kept, F.array(t["at"])).alias("kept"))).otherwise(state)

        numbers = F.aggregate("triggers", start, step).kept
    elif dedup == "relaxed":
        texts = F.transform("triggers", lambda t: t.text)
        numbers = F.transform(F.filter(F.transform("triggers", lambda t, i: F.struct(t["at"].alias("at"), (F.array_position(texts, t.text) == i + 1).alias("first"))), lambda t: t.first), lambda t: t["at"])
    first_use = F.transform("formals", lambda n: F.array_position(F.transform("each", lambda e: e.statement & F.array_contains(e.words, n)), True).cast("int") - 1)
    effective = F.size("triggers") > 0
    df = df.withColumn("chosen", F.when(effective, numbers).otherwise(F.array_distinct(F.filter(first_use, lambda i: i >= 0))))

    def valued(t: Column) -> Column:
        """Earlier statements of the blocks around a trigger that set its names."""
        target = F.transform(F.filter("triggers", lambda x: x["at"] == t), lambda x: F.transform(x.pairs, lambda p: F.regexp_replace(p, ":.*", "")))
        around = F.get("each", t).p.within
        sets = lambda e, i: e.statement & (i < t) & (e.p.kind == "simple") & F.arrays_overlap(e.updated, F.flatten(target)) & (e.p.within == F.slice(around, 1, F.size(e.p.within)))
        return F.filter(F.transform("each", lambda e, i: F.when(sets(e, i), i)), lambda i: i.isNotNull())

    df = df.withColumn("chosen", F.array_distinct(F.concat("chosen", F.flatten(F.transform("chosen", valued)))))
    around = F.flatten(F.transform("chosen", lambda i: F.get("each", i).p.within))
    df = df.withColumn("kept", F.array_union("chosen", around))
    gone_on = lambda: F.flatten(F.transform("kept", lambda i: F.get("each", i).p.chain))
    df = df.withColumn("kept", F.array_union("kept", gone_on()))
    # else, catch and finally with a block of their own stay with what they go on
    braced = F.transform(F.filter("each", lambda e: e.p.kind == "open"), lambda e: e.p.parent)
    stays = lambda e, i: (e.p.kind == "header") & F.arrays_overlap(F.slice(e.p.chain, 1, 1), "kept") & F.array_contains(braced, i)
    for _ in range(2):
        df = df.withColumn("kept", F.array_union("kept", F.filter(F.transform("each", lambda e, i: F.when(stays(e, i), i)), lambda i: i.isNotNull())))
    shown = lambda e, i: (i <= F.col("header")) | F.when(e.p.kind.isin("open", "close"), (e.p.parent == F.col("header")) | F.array_contains("kept", e.p.parent)).otherwise(F.array_contains("kept", i))
    df = df.withColumn("marks", F.transform("each", shown))
    breaks = lambda e: e.text.rlike(r"^[^\S\n]*\n")

    def rendered(e: Column, i: Column) -> Column:
        before = F.coalesce(F.get("marks", i - 1), F.lit(True))
        text = F.when(before | breaks(e), e.text).otherwise(F.concat(F.lit("\n"), e.text))
        return F.when(F.get("marks", i), text).when(before, F.concat(F.lit("\n"), F.when(breaks(e), F.regexp_extract(e.text, r"^\s*?([^\S\n]*)(?=\S)", 1)).otherwise(F.lit("")), F.lit(PLACEHOLDER)))

    df = df.withColumn("slice", F.array_join(F.filter(F.transform("each", rendered), lambda t: t.isNotNull()), ""))
    counted = F.filter(F.transform("each", lambda e, i: F.when(e.statement, F.get("marks", i))), lambda m: m.isNotNull())
    tokens = lambda text: F.size(F.regexp_extract_all(text, F.lit(TOKEN), 0))
    has = F.col("code").isNotNull()
    return df.select(
        "id",
        "hop",
        F.when(has, F.col("slice")).alias("slice"),
        F.when(has, effective).otherwise(False).alias("is_effective"),
        F.when(has, ~effective & (F.size("chosen") > 0)).otherwise(False).alias("is_fallback"),
        F.when(has, F.round(F.try_divide(F.size(F.filter(counted, lambda m: m)), F.size(counted)), 4)).alias("stmt_retention"),
        F.when(has, F.round(F.try_divide(tokens(F.col("slice")), tokens(F.col("clean"))), 4)).alias("token_retention"),
        F.when(~has, "code is missing").alias("error"),
    )
