"""Java code as statements, by array expressions of Spark alone.

One ``aggregate`` over the tokens of a method is a state machine that knows literals
(text blocks too), brackets, array initialisers, blocks and bodies without braces.  It
gives pieces that, joined, are the code again: statements up to their semicolon, headers
up to their closing parenthesis (or ``else``, ``do``, ``try``, ``finally`` alone), and
the braces of blocks.  Each piece holds the headers it lies in, so what encloses a
statement is looked up, not searched for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.columns import LITERAL

# Words of the Java language.
PARENTHESISED = ["if", "for", "while", "switch", "synchronized", "catch"]
BARE = ["else", "do", "try", "finally"]
CONTROLS = ["if", "else", "for", "while", "do", "switch", "synchronized", "try", "catch", "finally"]

TOKENS = rf"{LITERAL}|\w+|\s+|[;{{}}()\[\]]|[^\w\s;{{}}()\[\]\"']+|[\"']"
PIECE = "begin int, end int, kind string, lead string, parent int, within array<int>, chain array<int>"
STATE = ["i", "round", "begin", "lead", "last", "stack", "pieces", "popped"]


def tokens_of(code: Column) -> Column:
    return F.regexp_extract_all(code, F.lit(TOKENS), 0)


def _numbers(*values: Column) -> Column:
    return F.array(*values) if values else F.array().cast("array<int>")


def pieces_of(tokens: Column) -> Column:
    """array of pieces: begin, end (tokens), kind, lead (first word), parent (of a
    brace: its header), within (headers of the scopes around, outermost first), chain
    (of else, catch and finally: headers that they go on, the nearest first).

    A scope on the stack is twice its header's number, plus one if it ends with its
    first statement instead of a brace.
    """
    none = _numbers()
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("round"), F.lit(0).alias("begin"), F.lit(None).cast("string").alias("lead"), F.lit("").alias("last"), none.alias("stack"), F.array().cast(f"array<struct<{PIECE.replace(' ', ':').replace(',:', ',')}>>").alias("pieces"), none.alias("popped"))

    def step(s: Column, t: Column) -> Column:
        def state(**new: Column) -> Column:
            return F.struct(*((new[c] if c in new else s[c]).alias(c) for c in STATE))

        i, n = s.i + 1, F.size(s.pieces)
        lead = F.coalesce(s.lead, F.when(t.rlike(r"^\w"), t))
        headers = F.transform(s.stack, lambda x: F.shiftright(x, 1))
        top = F.get(s.stack, F.size(s.stack) - 1)
        waiting = F.coalesce(top.bitwiseAND(1) == 1, F.lit(False))

        def piece(kind: str, parent: Column, chain: Column = none) -> Column:
            return F.concat(s.pieces, F.array(F.struct(s.begin.alias("begin"), s.i.alias("end"), F.lit(kind).alias("kind"), lead.alias("lead"), parent.alias("parent"), headers.alias("within"), chain.alias("chain"))))

        def left(stack: Column) -> Column:
            """Without the scopes on top that end with the statement."""
            last = F.array_max(F.transform(stack, lambda x, k: F.when(x.bitwiseAND(1) == 0, k + 1).otherwise(0)))
            return F.slice(stack, 1, F.coalesce(last, F.lit(0)))

        def closed(stack: Column) -> Column:
            """Headers from the top down to where stack ends, and what those go on."""
            own = F.reverse(F.slice(headers, F.size(stack) + 1, F.size(headers)))
            return F.concat(own, F.flatten(F.transform(own, lambda h: F.get(s.pieces, h).chain)))

        def ended(pieces: Column, stack: Column, popped: Column = none) -> Column:
            return state(i=i, round=F.lit(0), begin=i, lead=F.lit(None).cast("string"), last=F.lit(""), stack=stack, pieces=pieces, popped=popped)

        outside = s.round == 0
        filling = s.last.rlike(r"[=\]]$")
        goes_on = F.when(lead.isin("else", "catch", "finally"), s.popped).otherwise(none)
        header = ended(piece("header", n, goes_on), F.concat(s.stack, _numbers(F.shiftleft(n, 1) + 1)))
        # a brace that belongs to the header before it, or a header with its own brace
        belongs = s.lead.isNull() & waiting
        inner = F.slice(s.stack, 1, F.size(s.stack) - 1)
        block = F.when(belongs, ended(piece("open", F.shiftright(top, 1)), F.concat(inner, _numbers(top - 1)))).otherwise(ended(piece("open", n), F.concat(s.stack, _numbers(F.shiftleft(n, 1)))))
        after = left(F.when(F.size(s.stack) > 0, inner).otherwise(none))
        close = ended(piece("close", F.coalesce(F.shiftright(top, 1), n)), after, closed(after))
        rest = left(s.stack)
        deeper = t.isin("(", "[") | (t == "{")
        round_ = F.when(deeper, s.round + 1).when(t.isin(")", "]", "}"), F.greatest(s.round - 1, F.lit(0))).otherwise(s.round)
        return (
            F.when(t.rlike(r"^\s"), state(i=i))
            .when(outside & (t == ";"), ended(piece("simple", n), rest, closed(rest)))
            .when(outside & (t == "{") & ~filling, block)
            .when(outside & (t == "}"), close)
            .when(outside & s.lead.isNull() & t.isin(*BARE), header)
            .when((s.round == 1) & (t == ")") & lead.isin(*PARENTHESISED), header)
            .otherwise(state(i=i, round=round_, lead=lead, last=t))
        )

    def finish(s: Column) -> Column:
        n = F.size(s.pieces)
        tail = F.struct(s.begin.alias("begin"), (s.i - 1).alias("end"), F.lit("simple").alias("kind"), s.lead.alias("lead"), n.alias("parent"), F.transform(s.stack, lambda x: F.shiftright(x, 1)).alias("within"), none.alias("chain"))
        return F.when(s.last != "", F.concat(s.pieces, F.array(tail))).otherwise(s.pieces)

    return F.aggregate(tokens, start, step, finish)


def text_of(tokens: Column, piece: Column) -> Column:
    return F.array_join(F.slice(tokens, piece.begin + 1, piece.end - piece.begin + 1), "")
