"""Golden cases worked out by hand, and properties of the row-local helpers."""

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.functions import expressions as X
from quern.operators.scoring import atom_agreement, compared, first_expression

# Inputs that pin how atoms and sets are compared.
ATOMS = [
    ("x != null", "null != x", 1.0, 1),
    ("x >= 0", "0 <= x", 1.0, 1),
    ("x > 0", "x >= 0", 0.9167, 0),
    ("n.LEN > 0", "n.LEN != 0", 1.0, 1),
    ("n.LEN >= 1", "0 < n.LEN", 1.0, 1),
    ("n.LEN > 1", "n.LEN != 1", round(2.5 / 3, 4), 0),
    ("ok == true", "ok != false", 1.0, 1),
    ("x > 1.50f", "x > 1.5", 1.0, 1),
    ("ready", "ready", 1.0, 1),
    ("ready", "read", 0.8, 0),
    ("abc < 7", "abd <= 7", round((2 / 3 + 3 / 4 + 1) / 3, 4), 0),
    ("p == q", "r != s", 0.0, 0),
    ('s == "a < b"', 's == "a > b"', round((1 + 1 + 6 / 7) / 3, 4), 0),
    ("a >> 2 > 1", "a >> 2 > 1", 1.0, 1),
]
SETS = [
    ("p", "q", 0, 0),
    ("p", "", 0, 0),
    ("", "q", 0, 0),
    ("", "", 1, 1),
    ("p || q && r", "(p || q) && r", 0.75, 0.5),
    ("p || q || r", "p || q", 0.66667, 1),
    ("p && (q || r)", "p && q", 0.75, 1),
    ("p && (q || r)", "p && q && r", 0.75, 0.66667),
    ("d > 0", "d == Long.MAX || d > 0", 1, 0.5),
    ("u != null && u.LEN > 0 && d > 0", "(u != null) && (u.LEN > 0)", 0.66667, 1),
    ("u != null && !(u.LEN == 0)", "u != null && u.LEN > 0", 1, 1),
]


@pytest.fixture(scope="module")
def agreed(spark):
    """(a, b) -> (strict, relaxed), both ways round."""
    pairs = {(a, b) for a, b, *_ in ATOMS} | {(b, a) for a, b, *_ in ATOMS}
    rows = atom_agreement(spark.createDataFrame(sorted(pairs), "a string, b string")).collect()
    return {(r.a, r.b): (r.strict, r.relaxed) for r in rows}


@pytest.mark.parametrize("a,b,relaxed,strict", ATOMS)
def test_atoms(agreed, a, b, relaxed, strict):
    assert agreed[a, b] == agreed[b, a] == (strict, pytest.approx(relaxed))


def test_set_matching(spark):
    rows = compared(spark.createDataFrame([s[:2] for s in SETS], "gold string, answer string")).collect()
    assert {(r.gold, r.answer): (r.relaxed_recall, r.relaxed_precision) for r in rows} == {s[:2]: s[2:] for s in SETS}


@pytest.mark.parametrize(
    "text,tree",
    [
        ("p || q && r", ("||", "p", ("&&", "q", "r"))),
        ("(p || q) && r", ("&&", ("||", "p", "q"), "r")),
        ("p && q && p", ("&&", "p", "q")),
        ("(u != null) && (u != null && !(u.LEN == 0))", ("&&", "u != null", "u.LEN != 0")),
        ("(u != null) && (u != null || !(u.LEN == 0))", ("&&", "u != null", ("||", "u != null", "u.LEN != 0"))),
        ("(p == q) && r", ("&&", "p == q", "r")),
        ('s == "p || q"', 's == "p || q"'),
        ("", ""),
        ("!p", "!p"),
        ("!(true)", "false"),
        ("p >> 2 > 1", "p >> 2 > 1"),
    ],
)
def test_trees(text, tree):
    assert X.tree(text) == tree


def test_numbered_trees():
    tree = X.tree("p && (q || p) && r > 1")
    assert list(X.leaves(tree)) == ["p", "q", "r > 1"] and X.numbered(tree, {"p": 0, "q": 1, "r > 1": 2}) == ["&&", 0, ["||", 1, 0], 2]
    assert list(X.leaves("")) == [] and X.numbered("", {}) == ""


def test_component_counts():
    assert [len(X.members_of(X.tree(t), 1)) for t in ("p || q || r", "p && (q || r)", "(u != null) && (n >= 0) && (u.LEN >= 0)", "")] == [1, 2, 3, 0]


CASES = ["p", "!p", "p && (q || !r)", "(p || q) && (r || s)", "!(u <= v)", "(u < v) && (v >= w)", "!(f(p) || g(q, r))", 't == null || !m.matches("[a]{2,3}", t)', "((n % 3) + 3) % 3 == 0", "p && (p || q)", "(u == v) || (u != v)", "p || !p && q"]


def truth(node, values):
    """Value of a formula; a comparison and its negation are opposite."""
    if isinstance(node, bool):
        return node
    if isinstance(node, list):
        return (any if node[0] == "||" else all)(truth(x, values) for x in node[1:])
    if len(node) == 3:
        low, flip = sorted((node[1], X.NEGATED[node[1]]))[0], False
        flip = node[1] != low
        return values.setdefault((node[0], low, node[2]), False) != flip
    return values.setdefault(node[0], False) == node[1]


def variables(node, out):
    if isinstance(node, list):
        for x in node[1:]:
            variables(x, out)
    elif not isinstance(node, bool):
        out.add((node[0], sorted((node[1], X.NEGATED[node[1]]))[0], node[2]) if len(node) == 3 else node[0])
    return out


def equivalent(a, b):
    names = sorted(variables(a, set()) | variables(b, set()), key=str)
    return all(truth(a, dict(zip(names, v, strict=True))) == truth(b, dict(zip(names, v, strict=True))) for v in itertools.product([False, True], repeat=len(names)))


@pytest.mark.parametrize("text", CASES)
def test_simplified_is_equivalent(text):
    assert equivalent(X.formula(text), X.formula(X.simplified(text)))
    assert X.simplified(X.simplified(text)) == X.simplified(text)


@pytest.mark.parametrize("text,want", [("a && true", "a"), ("a || false", "a"), ("a && false", "false"), ("a || true", "true"), ("!!a", "a"), ("(x < y) || (x >= y)", "true"), ("(x < y) && (x >= y)", "false"), ("x == x", "true"), ("!x == y", "x != y")])
def test_simplified(text, want):
    assert X.simplified(text) == want


formulas = st.recursive(st.sampled_from(["a", "b", "c", "x < y", "x >= y", "true"]), lambda s: st.one_of(s.map(lambda x: f"!({x})"), st.tuples(s, st.sampled_from([" && ", " || "]), s).map(lambda t: f"({t[0]}{t[1]}{t[2]})")), max_leaves=7)


@given(formulas)
@settings(max_examples=150, deadline=None)
def test_any_formula_keeps_its_meaning(text):
    assert equivalent(X.formula(text), X.formula(X.simplified(text)))


@pytest.mark.parametrize("text", ["", "a &&", "(a", "a)", "a == ", "&& b"])
def test_unreadable(text):
    with pytest.raises(ValueError):
        X.formula(text)


@given(st.lists(st.lists(st.floats(0, 1), min_size=4, max_size=4), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_assignment_against_all_permutations(gain):
    n, m = len(gain), 4
    small, large = (gain, m) if n <= m else ([list(c) for c in zip(*gain, strict=True)], n)
    want = max(sum(small[i][p[i]] for i in range(len(small))) for p in itertools.permutations(range(large), len(small)))
    assert X.best_assignment(gain) == pytest.approx(want)


def test_assignment_of_larger_matrices():
    rnd = random.Random(2)
    gain = [[rnd.random() for _ in range(6)] for _ in range(6)]
    assert X.best_assignment(gain) == pytest.approx(max(sum(gain[i][p[i]] for i in range(6)) for p in itertools.permutations(range(6))))


@pytest.mark.parametrize(
    "fragments,want",
    [
        (["x != null"], (0, "x != null")),
        (["None"], (0, "")),
        (["(true)"], (0, "")),
        (["a > 0\n\nThis holds because…"], (0, "a > 0")),
        (["int d = 3;"], (1, "parse_error: no extractable expression")),
        (["(a > 0 && b > 0"], (1, "parse_error: unmatched opening parenthesis")),
        (["a > 0) && b"], (1, "parse_error: mismatched parentheses")),
        (["a > 0 &&\n b < 1"], (0, "a > 0 && b < 1")),
        (["`x > 1`"], (0, "x > 1")),
        (["```java\nfoo(x)\n```"], (0, "foo(x)")),
        (["**\nx > 1"], (0, "x > 1")),
        (["This is prose.", "x > 2"], (0, "x > 2")),
        (["a > 0 &&\n```\nb > 0"], (0, "a > 0 && b > 0")),
        (["throw new X()", "isPositive"], (0, "isPositive")),
        ([], (1, "parse_error: no extractable expression")),
    ],
)
def test_first_expression(fragments, want):
    assert first_expression(fragments) == want
