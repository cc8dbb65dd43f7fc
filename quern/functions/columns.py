"""Column functions: everything of the evaluation that Spark can express itself."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.expressions import ACCEPTS, MIRROR, NEGATED, NO_CONSTRAINT, operator_similarity

# Literals of Java, text blocks, strings and characters.
LITERAL = r'''"""[\s\S]*?"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"''' + r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
# Patterns of answers and of Java expressions.
MARKER = r"(?is)^.*final\s+expression\s*(?:is)?\s*:"
FENCED = r"(?s)```[^\n]*\n(.*?)\n```"
INLINE = r"`+([^`]+)`+"
QUOTED = r'"[^"]*"'
REJECTING = [r";$", r"\bthrow\b", r"^\s*\b(?:int|long|double|float|boolean|char|byte|short|String|Object|final|void)\b\s[\w\[\]<>]+\s*=", r"\.$", r":$"]
REJECTING_UNQUOTED = [r"(?<![<>=!])=(?!=)", r"\.\s+[A-Za-z]", r"^\s*(?:-\s|\*\s|\*\*|#>?|[A-Za-z]+:\s|\d+[\.\):]\s)"]
EXPRESSION_MARK = r"&&|\|\||[<>=!]=?|[<>]|\binstanceof\b|[\w$.]+\s*\("
DANGLING = r"\s*(?:&&|\|\||[=!]=?|\s[<>]=?)\s*$"
ASSERTING = r"(?i:^assert)|\b(requireNonNull|checkNotNull|checkArgument|checkPositionIndex|checkPositionIndexes|checkElementIndex|notNull|hasText|notEmpty|isTrue|isFalse|hasLength|notBlank|matchesPattern|orElseThrow|checkState)$"
NAME = r"[\w.]+(?:\s*\(\s*\))?(?:\s*\.\w+(?:\s*\(\s*\))?)*"
CHAIN = r"[\w.]+(?:\s*\.\w+(?:\s*\(\s*\))?)*"
BEFORE = r"""(?:[^"'\\<>=!]|\\.|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|<<|>>>?|=(?!=)|!(?!=))*+"""
COMPARED = rf"(?s)^({BEFORE})(==|!=|<=|>=|<|>)(.*)$"
FILLED = [(">", "0"), ("!=", "0"), (">=", "1")]
EFFECTS = [(0.147, "Negligible"), (0.33, "Small"), (0.474, "Medium")]


def safe_f1(p: Column, r: Column, digits: int | None = 5) -> Column:
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return f1 if digits is None else F.round(f1, digits)


def text_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 0.0).otherwise(1 - F.levenshtein(a, b) / longest)


def operator_overlap(a: Column, b: Column) -> Column:
    """Weighted overlap of two comparison operators; null if one is unknown."""
    return F.element_at(F.create_map(*(F.lit(x) for p in ACCEPTS for q in ACCEPTS for x in (f"{p} {q}", operator_similarity(p, q)))), F.concat_ws(" ", a, b))


def effect_label(delta: Column) -> Column:
    out = F.when(delta.isNull(), None)
    for below, label in EFFECTS:
        out = out.when(F.abs(delta) < below, label)
    return out.otherwise("Large")


def snippet(code: Column) -> Column:
    """Stripped, and every line without blanks at its end."""
    return F.regexp_replace(F.regexp_replace(code, r"^\s+|\s+$", ""), r"[^\S\n]+(?=\n)", "")


def without_comments(code: Column) -> Column:
    """Java code without comments; literals stay as they are."""
    return F.regexp_replace(code, rf"({LITERAL})|//[^\n]*|(?s:/\*.*?\*/)", "$1")


def without_empty_lines(code: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(code, r"(?m)^[^\S\n]*\n", ""), r"\n\s*$", "")


def asserting_call(name: Column) -> Column:
    return name.rlike(ASSERTING)


def candidates(answer: Column) -> Column:
    """Fragments that may be the expression, the likeliest first: behind the last
    marker, fenced code, inline code, paragraphs, each from the last to the first."""
    marked = F.when(answer.rlike(MARKER), F.array(F.trim(F.regexp_replace(answer, MARKER, "")))).otherwise(F.array().cast("array<string>"))
    paragraphs = F.filter(F.transform(F.split(answer, "\n\n"), lambda p: F.trim(p)), lambda p: p != "")
    return F.concat(marked, F.reverse(F.regexp_extract_all(answer, F.lit(FENCED), 1)), F.reverse(F.regexp_extract_all(answer, F.lit(INLINE), 1)), F.reverse(paragraphs))


def rejected(text: Column) -> Column:
    """Whether a fragment is a statement or prose."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    unquoted = F.regexp_replace(s, QUOTED, "")
    out = s == ""
    for p in REJECTING:
        out = out | s.rlike(p)
    for p in REJECTING_UNQUOTED:
        out = out | unquoted.rlike(p)
    return out | (s.rlike(r"\s") & ~s.rlike(EXPRESSION_MARK))


def format_error(text: Column) -> Column:
    """Null, or why a fragment can't be an expression."""
    s = F.regexp_replace(text, r"^\s+|\s+$", "")
    depths = F.aggregate(
        F.filter(F.split(s, ""), lambda c: c.isin("(", ")")),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")),
        lambda t, c: F.struct((t.now + F.when(c == "(", 1).otherwise(-1)).alias("now"), F.least(t.least, t.now + F.when(c == "(", 1).otherwise(-1)).alias("least")),
    )
    return F.when(depths.least < 0, "parse_error: mismatched parentheses").when(depths.now > 0, "parse_error: unmatched opening parenthesis").when(s.rlike(DANGLING), "parse_error: trailing dangling operator")


def no_constraint(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"^[\s(]+|[\s)]+$", "")).isin(*NO_CONSTRAINT)


# What may stand before .equals, at the end of a text.
RECEIVER = r"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[\w.]+(?:\s*\(\s*\)|\.\w+)*)"""
BRACKETS = r"""(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+'|[()]|[^()"']+|["']"""


def equals_calls(text: Column) -> Column:
    """x.equals(y) as (x == y), at any depth: y may hold brackets and other such calls.

    A fold over brackets, literals and what is between them keeps what stands before
    each open bracket; at its closing one a call is written anew, so inner calls are
    done before outer ones.  A bracket that is never closed stays as it is.
    """
    called = rf"(?s)^(.*?)({RECEIVER})\.equals(\s*)$"
    start = F.struct(F.lit("").alias("now"), F.array().cast("array<struct<head:string,receiver:string,gap:string>>").alias("open"))

    def step(s: Column, t: Column) -> Column:
        part = lambda k: F.regexp_extract(s.now, called, k)
        call = s.now.rlike(called)
        opened = F.struct(F.when(call, part(1)).otherwise(s.now).alias("head"), F.when(call, part(2)).alias("receiver"), part(3).alias("gap"))
        top, outer = F.get(s.open, F.size(s.open) - 1), F.slice(s.open, 1, F.size(s.open) - 1)
        closed = F.when(top.receiver.isNull(), F.concat(top.head, F.lit("("), s.now, F.lit(")"))).otherwise(F.concat(top.head, F.lit("("), top.receiver, F.lit(" == "), F.regexp_replace(s.now, r"^\s+|\s+$", ""), F.lit(")")))
        state = lambda now, stack: F.struct(now.alias("now"), stack.alias("open"))
        return F.when(t == "(", state(F.lit(""), F.concat(s.open, F.array(opened)))).when((t == ")") & (F.size(s.open) > 0), state(closed, outer)).otherwise(state(F.concat(s.now, t), s.open))

    unclosed = lambda f: F.concat(f.head, F.coalesce(F.concat(f.receiver, F.lit(".equals"), f.gap), F.lit("")), F.lit("("))
    folded = F.aggregate(F.regexp_extract_all(text, F.lit(BRACKETS), 0), start, step, lambda s: F.concat(F.array_join(F.transform(s.open, unclosed), ""), s.now))
    return F.when(text.contains(".equals"), folded).otherwise(text)


def canonical(text: Column) -> Column:
    """Java idioms for emptiness, length, equality and type in one form."""
    t = F.regexp_replace(text, rf"(?:StringUtils|CollectionUtils|ObjectUtils)\.isEmpty\s*\(\s*({NAME})\s*\)", "($1 == null || $1.isEmpty())")
    t = F.regexp_replace(t, rf"StringUtils\.isBlank\s*\(\s*({NAME})\s*\)", "($1 == null || $1.isBlank())")
    t = F.regexp_replace(t, rf"ArrayUtils\.isEmpty\s*\(\s*({NAME})\s*\)", "($1 == null || $1.length == 0)")
    t = F.regexp_replace(t, r"(?<!\.)\b(length|size|isEmpty|isBlank)\(\)", "this.$1()")
    t = equals_calls(t)
    t = F.regexp_replace(t, rf"({NAME})\s+instanceof\s+([\w.]+)", "$1.TYPE == $2")
    t = F.regexp_replace(t, rf"({CHAIN})(?:\.length\(\)|\.size\(\)|\.length\b)", "$1.LEN")
    t = F.regexp_replace(t, r"\.isBlank\(\)", ".trim().isEmpty()")
    t = F.regexp_replace(t, rf"({CHAIN})\.isEmpty\(\)", "($1.LEN == 0)")
    return F.when(no_constraint(text), "").otherwise(t)


def number_form(text: Column) -> Column:
    """Operands without type suffix and trailing zeros."""
    t = F.regexp_replace(F.trim(text), r"(?i)([0-9.]+)[fdl]$", "$1")
    short = F.regexp_replace(F.regexp_replace(t, "0+$", ""), r"\.$", "")
    return F.when(t.contains("."), F.when(short == "", "0").otherwise(short)).otherwise(t)


def comparison(atom: Column) -> Column:
    """struct<l, o, r> at the first comparison outside quotes; o is empty if there is none."""
    part = lambda k: F.regexp_extract(atom, COMPARED, k)
    return F.struct(number_form(part(1)).alias("l"), part(2).alias("o"), number_form(part(3)).alias("r"))


def readings(c: Column) -> Column:
    """A comparison, its mirror image, and what is equivalent to either."""
    of = lambda names, o: F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), o)
    triple = lambda l, o, r: F.struct(l.alias("l"), o.alias("o"), r.alias("r"))  # noqa: E741,E731
    none = F.array().cast("array<struct<l:string,o:string,r:string>>")

    def all_of(x: Column) -> Column:
        truth = x.r.isin("true", "false") & x.o.isin("==", "!=")
        opposite = triple(x.l, of(NEGATED, x.o), F.when(x.r == "true", "false").otherwise("true"))
        filled = x.l.endswith(".LEN") & F.concat_ws(" ", x.o, x.r).isin(*map(" ".join, FILLED))
        return F.concat(F.array(x), F.when(truth, F.array(opposite)).otherwise(none), F.when(filled, F.array(*(triple(x.l, F.lit(o), F.lit(r)) for o, r in FILLED))).otherwise(none))

    return F.flatten(F.transform(F.array(triple(c.l, c.o, c.r), triple(c.r, of(MIRROR, c.o), c.l)), all_of))


def agreement_of_atoms(a: str, b: str, x: str, y: str, rx: str, ry: str) -> tuple[Column, Column]:
    """Strict and relaxed agreement from columns: the atoms' texts, comparisons and readings."""
    x, y = F.col(x), F.col(y)
    mirrored = (x.l == y.r) & (x.r == y.l) & F.array_contains(F.transform(rx, lambda p: p.o), y.o) & F.exists(rx, lambda p: (p.l == y.l) & (p.o == y.o) & (p.r == y.r))
    best = F.array_max(F.flatten(F.transform(rx, lambda p: F.transform(ry, lambda q: (text_similarity(p.l, q.l) + operator_overlap(p.o, q.o) + text_similarity(p.r, q.r)) / 3))))
    plain = text_similarity(F.col(a), F.col(b))
    relaxed = F.when((x.o == "") | (y.o == ""), plain).when(x.eqNullSafe(y) | mirrored, 1.0).otherwise(F.round(best, 4))
    same = F.replace(F.col(a), F.lit(" "), F.lit("")) == F.replace(F.col(b), F.lit(" "), F.lit(""))
    return (same | (relaxed >= 0.9999)).cast("double"), relaxed
