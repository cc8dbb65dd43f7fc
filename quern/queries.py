"""Registered queries of the evaluation's operators, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import columns as C
from quern.functions.expressions import ACCEPTS, MIRROR
from quern.jobs import carriers, evaluation
from quern.operators import inference, metrics, prompts, retrieval, scoring, significance, slices
from quern.session import table
from quern.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# Methods, answers and scores derived from part, in SQL.


def _fill(template: str) -> str:
    return "'" + template.replace("{p}", "' || p_partkey || '").replace("{s}", "' || p_size || '") + "'"


def _case(values: list[str]) -> str:
    return "CASE p_partkey %% %d %s END" % (len(values), " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)))


def _list(values: list[str], at: str) -> str:
    return f"[{', '.join(repr(v) for v in values)}][1 + ({at}) % {len(values)}]"


def _sliced(method: list, hop: int) -> str:
    """The slice that the marks of a method's lines tell."""
    out: list[str] = []
    for mark, line, *clean in method:
        if mark == "f" or mark != "x" and str(hop) in mark:
            out.append((clean[0] if clean else line).rstrip())
        elif mark != "x" and not (out and out[-1].strip() == slices.PLACEHOLDER):
            out.append(line[: len(line) - len(line.lstrip())] + slices.PLACEHOLDER)
    return "\n".join(out)


def _share(method: list, hop: int) -> str:
    """Kept statements among all; a line with braces only is none."""
    of = [m for m, line, *_ in method if m not in ("f", "x") and "c" not in m]
    return f"{round(sum(str(hop) in m for m in of) / len(of), 4)}::DOUBLE"


_OPS = list(ACCEPTS)
_OVERLAP = {"== <=": "1.0/4", "== >=": "1.0/4", "!= <": "1.0/2", "!= >": "1.0/2", "!= <=": "3.0/7", "!= >=": "3.0/7", "<= <": "3.0/4", ">= >": "3.0/4", "<= >=": "1.0/7"}
_OVERLAP_CASE = " ".join(f"WHEN (a, b) IN (('{p}', '{q}'), ('{q}', '{p}')) THEN {v}" for k, v in _OVERLAP.items() for p, q in [k.split()])
_CODE = _case([_fill("\n".join(line[1] for line in m)) for m in carriers.JAVA])
_BARE = _case([_fill("\n".join(line[-1] for line in m if line[0] != "x")) for m in carriers.JAVA])
_SLICE = lambda hop: _case([_fill(_sliced(m, hop)) for m in carriers.JAVA])
_LINKED = "CASE WHEN p_partkey % 2 = 0 THEN ' && ' ELSE ' || ' END"
_GOLD = f"""CASE WHEN p_partkey % 17 = 5 THEN '' ELSE {_list(carriers.NAMES, "p_partkey")} || ' ' || {_list(_OPS, "p_size")} || ' ' || p_size
 || CASE WHEN p_partkey % 3 = 0 THEN {_LINKED} || {_list(carriers.NAMES, "p_partkey + 1")} || '.size() ' || {_list(carriers.LENGTHS, "p_partkey")} ELSE '' END END"""
_METHODS = f"m AS (SELECT p_partkey::VARCHAR AS id, p_brand AS project_name, {_CODE} AS code_formatted, {_GOLD} AS doc_constraint FROM part)"
_CONFIG_SQL = "(VALUES " + ", ".join("('%s', %s, %s, '%s', %d)" % (s, f"'{v}'" if v else "NULL", k or "NULL", f"{v} k={k}" if k else f"{s}-{v}" if v else s, n) for n, (s, v, k, _) in enumerate(carriers.CONFIGS)) + ") c(strategy, variant, k, config, c)"
# members of gold and answer: name, operator, number
_PARTS = f"""answer_parts AS (SELECT p_partkey, c, j, CASE WHEN flip THEN r ELSE l END AS l, CASE WHEN flip THEN {_list([MIRROR[o] for o in _OPS], "place")} ELSE {_list(_OPS, "place")} END AS o, CASE WHEN flip THEN l ELSE r END AS r FROM (
  SELECT p_partkey, c, 1 AS j, p_partkey % 7 = 1 AS flip, p_size + (p_partkey + c) % 4 AS place, {_list(carriers.NAMES, "p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END")} AS l, (p_size + (p_partkey + c) % 3)::VARCHAR AS r FROM part, {_CONFIG_SQL} WHERE (p_partkey + c) % 19 <> 7)
 UNION ALL SELECT p_partkey, c, 2, {_list(carriers.NAMES, "p_partkey + 1")} || '.LEN', split_part(n, ' ', 1), split_part(n, ' ', 2) FROM (SELECT *, {_list(carriers.LENGTHS, "p_partkey + c")} AS n FROM part, {_CONFIG_SQL} WHERE p_partkey % 4 = 0 AND (p_partkey + c) % 19 <> 7)),
gold_parts AS (SELECT p_partkey, 1 AS i, {_list(carriers.NAMES, "p_partkey")} AS l, {_list(_OPS, "p_size")} AS o, p_size::VARCHAR AS r FROM part WHERE p_partkey % 17 <> 5
 UNION ALL SELECT p_partkey, 2, {_list(carriers.NAMES, "p_partkey + 1")} || '.LEN', split_part(n, ' ', 1), split_part(n, ' ', 2) FROM (SELECT *, {_list(carriers.LENGTHS, "p_partkey")} AS n FROM part WHERE p_partkey % 17 <> 5 AND p_partkey % 3 = 0))"""
_MIRRORED = "CASE o " + " ".join(f"WHEN '{o}' THEN '{m}'" for o, m in MIRROR.items()) + " END"
_ALIKE = "CASE WHEN greatest(length({0}), length({1})) = 0 THEN 0.0 ELSE 1 - levenshtein({0}, {1}) / greatest(length({0}), length({1}))::DOUBLE END"
_ATOMS = f"""atoms AS (SELECT DISTINCT l, o, r FROM (SELECT l, o, r FROM gold_parts UNION ALL SELECT l, o, r FROM answer_parts)),
forms AS (SELECT l AS al, o AS ao, r AS ar, l, o, r FROM atoms UNION SELECT l, o, r, r, {_MIRRORED}, l FROM atoms),
readings AS (SELECT * FROM forms UNION SELECT al, ao, ar, l, x.o, x.r FROM forms f, (VALUES ('>', '0'), ('!=', '0'), ('>=', '1')) x(o, r) WHERE f.l LIKE '%.LEN' AND (f.o, f.r) IN (('>', '0'), ('!=', '0'), ('>=', '1'))),
pairs AS (SELECT DISTINCT g.l AS gl, g.o AS go, g.r AS gr, a.l AS al, a.o AS ao, a.r AS ar FROM gold_parts g JOIN answer_parts a USING (p_partkey)),
agreed AS (SELECT *, (gl = al AND go = ao AND gr = ar OR relaxed >= 0.9999)::INT::DOUBLE AS strict FROM (
 SELECT gl, go, gr, al, ao, ar, CASE WHEN max((gl = al AND go = ao AND gr = ar OR EXISTS (SELECT 1 FROM forms m WHERE (m.al, m.ao, m.ar) = (gl, go, gr) AND (m.l, m.o, m.r) = (t.al, t.ao, t.ar)))::INT) = 1 THEN 1.0 ELSE round(max((x + (CASE WHEN a = b THEN 1.0 {_OVERLAP_CASE} ELSE 0.0 END)::DOUBLE + y) / 3), 4) END::DOUBLE AS relaxed FROM (
  SELECT p.*, {_ALIKE.format("g.l", "h.l")} AS x, g.o AS a, h.o AS b, {_ALIKE.format("g.r", "h.r")} AS y
  FROM pairs p JOIN readings g ON (g.al, g.ao, g.ar) = (gl, go, gr) JOIN readings h ON (h.al, h.ao, h.ar) = (p.al, p.ao, p.ar)) t GROUP BY ALL))"""


def _scores(digits: int) -> str:
    """scored: by part and configuration, as if every answer could be read."""
    one = lambda kind, i, j: f"max(CASE WHEN i = {i} AND j = {j} THEN {kind} END)"
    best = lambda k: f"CASE WHEN ng = 2 AND na = 2 THEN greatest({k}11 + {k}22, {k}12 + {k}21) ELSE greatest({k}11, {k}12, {k}21) END"
    share = lambda k, n: f"CASE WHEN ng = 0 OR na = 0 THEN (ng = na)::INT::DOUBLE ELSE round(({best(k)}) / {n}, {digits}) END"
    f1 = lambda m: f"CASE WHEN {m}_precision + {m}_recall = 0 THEN 0.0 ELSE round(2 * {m}_precision * {m}_recall / ({m}_precision + {m}_recall), {digits}) END::DOUBLE AS {m}_f1"
    cells = ", ".join(f"{one(kind, i, j)} AS {kind[0]}{i}{j}" for kind in ("strict", "relaxed") for i in (1, 2) for j in (1, 2))
    return f"""{_PARTS}, {_ATOMS},
cells AS (SELECT p_partkey, c, {cells} FROM gold_parts g JOIN answer_parts a USING (p_partkey) JOIN agreed x ON (gl, go, gr) = (g.l, g.o, g.r) AND (x.al, x.ao, x.ar) = (a.l, a.o, a.r) GROUP BY ALL),
sizes AS (SELECT p_partkey, p_size, p_brand, strategy, config, c, (SELECT count(*) FROM gold_parts g WHERE g.p_partkey = part.p_partkey) AS ng, (SELECT count(*) FROM answer_parts a WHERE a.p_partkey = part.p_partkey AND a.c = d.c) AS na FROM part, {_CONFIG_SQL.replace(") c(", ") d(")}),
scored AS (SELECT *, {f1("strict")}, {f1("relaxed")}, CASE WHEN p_partkey % 2 = 0 THEN ng ELSE least(ng, 1) END::INT AS gold_subs, CASE WHEN p_partkey % 2 = 0 THEN na ELSE least(na, 1) END::INT AS answer_subs FROM (
 SELECT *, {share("s", "na")} AS strict_precision, {share("s", "ng")} AS strict_recall, {share("r", "na")} AS relaxed_precision, {share("r", "ng")} AS relaxed_recall FROM sizes LEFT JOIN cells USING (p_partkey, c)))"""


_COLUMNS = ["strict_precision", "strict_recall", "strict_f1", "relaxed_precision", "relaxed_recall", "relaxed_f1"]
_SCORED = f"""{_scores(5)},
s AS (SELECT strategy, config, p_partkey::VARCHAR AS id, (p_partkey % 13 = 0)::INT AS parse_failed, (p_partkey % 13 <> 0 AND na = 0) AS is_none, gold_subs AS doc_constraint_subs,
 CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE answer_subs END AS code_constraint_subs,
 {", ".join(f"CASE WHEN p_partkey % 13 = 0 THEN 0.0 ELSE {c} END::DOUBLE AS {c}" for c in _COLUMNS)},
 p_size AS input_tokens, p_size % 7 AS output_tokens, p_size / 4.0::DOUBLE AS elapsed_seconds
 FROM scored WHERE p_partkey % 11 <> 0)"""
_SCORE_COLUMNS = [*_COLUMNS, "doc_constraint_subs", "code_constraint_subs"]


@query(f"WITH {_SCORED} SELECT strategy, id, parse_failed, {', '.join(_SCORE_COLUMNS)} FROM s")
def evaluate_answers(spark, sf):
    return scoring.evaluated(carriers.methods(spark, sf), carriers.answers(spark, sf)).select("strategy", "id", "parse_failed", *_SCORE_COLUMNS)


@query(
    f"""WITH {_SCORED} SELECT config, count(*) AS n, {", ".join(f"round(avg({c}), 3) AS {c}" for c in metrics.MEANS)},
 round(100.0 * count(*) FILTER (parse_failed = 1) / count(*), 2) AS parse_fail_pct, round(100.0 * count(*) FILTER (is_none) / count(*), 2) AS none_pct,
 round(100.0 * count(*) FILTER (strict_f1 = 1.0) / count(*), 2) AS exact_match_pct FROM s GROUP BY config"""
)
def summary_by_config(spark, sf):
    return evaluation.summary(carriers.methods(spark, sf), carriers.answers(spark, sf))


@query(f"WITH {_SCORED} SELECT config, count(*) AS rows, count(*) FILTER (parse_failed = 1) AS parse_failed, count(*) FILTER (is_none) AS empty, 0::BIGINT AS errors FROM s GROUP BY config")
def failure_counts(spark, sf):
    return metrics.failure_counts(evaluation.metrics(carriers.methods(spark, sf), carriers.answers(spark, sf)), "config")


@query(f"WITH {_PARTS}, {_ATOMS} SELECT gl || ' ' || go || ' ' || gr AS a, al || ' ' || ao || ' ' || ar AS b, strict, relaxed FROM agreed")
def atom_similarity(spark, sf):
    """Every member of a gold constraint with every member of an answer to it."""
    m, a = carriers.methods(spark, sf), carriers.answers(spark, sf).filter("strategy is not null").select("id")
    parts = lambda text: F.filter(F.split(F.regexp_replace(C.canonical(text), r"[()]", ""), r" (?:&&|\|\|) "), lambda x: x != "")
    p = table(spark, sf, "part")
    said = p.select(F.col("p_partkey").cast("string").alias("id"), F.explode(F.array(*(carriers.answered(F.lit(n)) for n in range(len(carriers.CONFIGS))))).alias("said"))
    pairs = m.select("id", F.explode(parts(F.col("doc_constraint"))).alias("a")).join(said.select("id", F.explode(parts(F.col("said"))).alias("b")), "id")
    return scoring.atom_agreement(pairs)


_BASE = f"""{_scores(4)},
w AS (SELECT p_partkey::VARCHAR AS id, p_partkey % 5 IN (3, 4) AND na > 0 AS usable, p_size % 4 AS wit_path_count, gold_subs AS doc_constraint_subs, answer_subs, (p_partkey % 3 = 0)::INT AS none_pct, {", ".join(_COLUMNS)} FROM scored WHERE c = 0 AND p_partkey % 11 <> 0),
b AS (SELECT id, wit_path_count, doc_constraint_subs, CASE WHEN usable THEN answer_subs ELSE 0 END AS wit_result_subs, none_pct, (usable AND strict_f1 = 1.0)::INT AS exact_match, {", ".join(f"CASE WHEN usable THEN {c} ELSE 0.0 END::DOUBLE AS {c}" for c in _COLUMNS)} FROM w)"""


@query(f"WITH {_BASE} SELECT * FROM b")
def baseline_evaluation(spark, sf):
    found = metrics.baseline_evaluated(carriers.methods(spark, sf), carriers.baseline(spark, sf))
    return found.select("id", *metrics.BASELINE_MEANS, "none_pct", "exact_match")


@query(f"WITH {_BASE} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 4) AS {c}' for c in metrics.BASELINE_MEANS)}, round(100 * avg(none_pct), 2) AS none_pct, round(100 * avg(exact_match), 2) AS exact_match FROM b")
def baseline_summary(spark, sf):
    return metrics.baseline_summary(metrics.baseline_evaluated(carriers.methods(spark, sf), carriers.baseline(spark, sf)))


@query(f"WITH {_METHODS} SELECT id, doc_constraint FROM m WHERE id::BIGINT % 11 = 0")
def missing_answers(spark, sf):
    return carriers.methods(spark, sf).join(carriers.answers(spark, sf).select("id").distinct(), "id", "left_anti").select("id", "doc_constraint")


@query("SELECT p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 17 = 5 THEN 0 WHEN p_partkey % 6 = 0 THEN 2 ELSE 1 END::INT AS parts FROM part")
def component_counts(spark, sf):
    gold = carriers.methods(spark, sf).select("id", F.col("doc_constraint").alias("gold"))
    return gold.join(scoring.compared(gold.select("gold", F.lit("").alias("answer"))).select("gold", F.col("gold_parts").alias("parts")), "gold").select("id", "parts")


@query("SELECT DISTINCT strategy, 'missing' AS model FROM (VALUES ('vanilla'), ('fewshot'), ('cot'), ('slice'), ('mix')) t(strategy), part")
def missing_configurations(spark, sf):
    a = carriers.answers(spark, sf)
    wanted = a.select("strategy").distinct().withColumn("model", F.lit("missing"))
    return metrics.missing_configurations(wanted.unionByName(a.select("strategy", "model").distinct()), a, "strategy", "model")


@query("SELECT doc_id, quality FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, 0 AS quality FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def overlay_resolve(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    return tables.overlaid(labels, table(spark, sf, "documents").select("doc_id", F.lit(0).alias("quality")), "doc_id")


@query("SELECT d.doc_id, lang, quality, toxic FROM documents d JOIN labels l ON d.doc_id::VARCHAR = l.doc_id::VARCHAR")
def id_join(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    return d.select("doc_id", "lang").join(lab, "doc_id")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_anti(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def last_dup_wins(spark, sf):
    return tables.last_by_key(table(spark, sf, "events").select("user_id", "event_id", "ts"), "user_id", "ts", "event_id").select("user_id", "event_id")


@query("SELECT true AS is_mean, 'mean' AS c_name, printf('%.3f', avg(c_acctbal)) AS c_acctbal FROM customer UNION ALL SELECT false, c_name, printf('%.5f', c_acctbal) FROM customer")
def macro_mean_row(spark, sf):
    return metrics.with_mean_row(table(spark, sf, "customer"), "c_name", "c_acctbal")


@query("SELECT lang, count(*) AS n, round(avg(quality), 4) AS quality, round(100 * avg(toxic), 2) AS toxic_pct FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def flag_percentages(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 4).alias("quality"), F.round(F.avg("toxic") * 100, 2).alias("toxic_pct"))


@query("SELECT p_partkey, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM (SELECT p_partkey, p_size / 50.0::DOUBLE AS p, (p_partkey % 10) / 10.0::DOUBLE AS r FROM part)")
def safe_f1(spark, sf):
    return table(spark, sf, "part").select("p_partkey", C.safe_f1(F.col("p_size") / 50.0, (F.col("p_partkey") % 10) / 10.0, None).alias("f1"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g'), '[ \t\f\r]+\n', chr(10), 'g') AS code FROM documents")
def snippet_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", C.snippet(F.col("text")).alias("code"))


@query("SELECT doc_id, source FROM documents WHERE coalesce(trim(text), '') <> ''")
def nonblank_filter(spark, sf):
    return tables.with_code(table(spark, sf, "documents").select("doc_id", "source", "text"), "text").select("doc_id", "source")


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("project"), "embedding")


def _topk(k: int, test: str) -> str:
    return f"""SELECT id, example_id, cos, rank FROM (SELECT a.vec_id AS id, b.vec_id AS example_id, round(c, 4) AS cos, row_number() OVER (PARTITION BY a.vec_id ORDER BY c DESC, b.vec_id) AS rank
 FROM (SELECT a.*, b.*, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS c FROM embeddings a JOIN embeddings b ON a.label <> b.label) t(vec_id_a, ea, la, vec_id_b, eb, lb, c), LATERAL (SELECT vec_id_a AS vec_id) a, LATERAL (SELECT vec_id_b AS vec_id) b WHERE c {test}) WHERE rank <= {k}"""


@query(_topk(5, "< 0.9"))
def semantic_topk(spark, sf):
    v = _vectors(spark, sf)
    return retrieval.similar_items(v, v, 5, 0.9).select("id", "example_id", "cos", "rank")


@query(_topk(5, ">= 0.3"))
def semantic_topk_over(spark, sf):
    v = _vectors(spark, sf)
    return retrieval.similar_items(v, v, 5, 0.3, below=False).select("id", "example_id", "cos", "rank")


@query(f"SELECT id, string_agg(example_id, ',' ORDER BY rank DESC) AS examples FROM ({_topk(5, '< 0.9')}) GROUP BY id")
def fewshot_reverse(spark, sf):
    v = _vectors(spark, sf)
    return retrieval.example_lists(retrieval.similar_items(v, v, 5, 0.9), 5).select("id", F.array_join("example_ids", ",").alias("examples"))


_DRAWN = "('0x' || substr(md5('42|' || id || '|' || j[1]), 1, 15))::BIGINT % (j[1] + 1)"


@query(
    f"""WITH placed AS (SELECT vec_id AS id, label AS project, row_number() OVER (ORDER BY label, md5('42|' || vec_id), vec_id) - 1 AS place FROM embeddings),
 asked AS (SELECT id, start, own, (SELECT count(*) FROM placed) - own AS others FROM placed JOIN (SELECT project, min(place) AS start, count(*) AS own FROM placed GROUP BY project) USING (project)),
 drawn AS (SELECT id, start, own, unnest(list_reduce(list_prepend([]::BIGINT[], list_transform(range(greatest(others - 5, 0), others), lambda j: [j])),
  lambda s, j: list_append(s, CASE WHEN list_contains(s, {_DRAWN}) THEN j[1] ELSE {_DRAWN} END))) AS x FROM asked)
 SELECT d.id, p.id AS example_id, (row_number() OVER (PARTITION BY d.id ORDER BY md5('42|' || d.id || '|' || x || '|order')))::INT AS rank FROM drawn d JOIN placed p ON p.place = CASE WHEN x < start THEN x ELSE x + own END"""
)
def random_topk(spark, sf):
    v = _vectors(spark, sf).select("id", "project")
    return retrieval.random_items(v, v, 5)


TASK = "Extract the constraints.\n\n"


@query(f"WITH {_METHODS} SELECT id, 'Extract the constraints.\n\n' || 'Target Method:\n' || code_formatted || '\n' AS prompt FROM m")
def prompt_vanilla(spark, sf):
    return prompts.prompts(carriers.methods(spark, sf), TASK)


_NEXT = "x AS (SELECT id, (1 + (id::BIGINT * 7 + r) % (SELECT max(p_partkey) FROM part))::VARCHAR AS example_id, r AS rank FROM m, range(1, 4) t(r))"


def _examples(spark, sf):
    most = F.broadcast(table(spark, sf, "part").agg(F.max("p_partkey").alias("most")))
    m = carriers.methods(spark, sf).select("id").join(most)
    return m.select("id", "most", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("rank")).select("id", (1 + (F.col("id").cast("long") * 7 + F.col("rank")) % F.col("most")).cast("string").alias("example_id"), "rank")


@query(
    f"""WITH {_METHODS}, {_NEXT}, y AS (SELECT x.id, rank, row_number() OVER (PARTITION BY x.id ORDER BY rank DESC) AS i, m.code_formatted, m.doc_constraint FROM x JOIN m ON m.id = x.example_id WHERE x.id <> x.example_id),
 z AS (SELECT id, string_agg('\nExample ' || i || ':\nTarget Method:\n' || code_formatted || '\n\nOutput:\n' || doc_constraint || '\n', '' ORDER BY i) AS s FROM y GROUP BY id)
 SELECT m.id, 'Extract the constraints.\n\n' || coalesce('Few-Shot Examples:\n' || s || '\n----------------------------------------\n\nNow analyze the Target Method below:\n\n', '') || 'Target Method:\n' || code_formatted || '\n' AS prompt FROM m LEFT JOIN z USING (id)"""
)
def prompt_fewshot(spark, sf):
    m = carriers.methods(spark, sf)
    return prompts.prompts(m, TASK, prompts.example_sections(_examples(spark, sf), m, 3))


def _shown(mark: str, hop: int) -> str:
    """Whether a line is kept at a depth as a trigger, or (mark F) as a first use."""
    shown = lambda line: str(hop) in line and (f"F{hop}" in line) == (mark == "F")
    return "[" + ", ".join(str(any(shown(line[0]) for line in m)).lower() for m in carriers.JAVA) + f"][1 + p_partkey % {len(carriers.JAVA)}]"


_TOKENS = r"len(regexp_extract_all({}, '\w+|[^\w\s]'))"
_SLICES = " UNION ALL ".join(
    f"""SELECT id, hop, CASE WHEN has THEN slice END AS slice, has AND effective AS is_effective, has AND fallback AS is_fallback, CASE WHEN has THEN share END AS stmt_retention, CASE WHEN has THEN round({_TOKENS.format("slice")} / {_TOKENS.format("bare")}::DOUBLE, 4) END AS token_retention, CASE WHEN NOT has THEN 'code is missing' END AS error
 FROM (SELECT p_partkey::VARCHAR AS id, p_partkey % 23 <> 0 AS has, {hop} AS hop, {_SLICE(hop)} AS slice, {_BARE} AS bare, {_shown("", hop)} AS effective, {_shown("F", hop)} AS fallback, {_case([_share(m, hop) for m in carriers.JAVA])} AS share FROM part)"""
    for hop in (0, 1, 2)
)


@query(_SLICES)
def slice_methods(spark, sf):
    """Slices at three depths; every 23rd method has no code."""
    code = F.when(F.col("id").cast("long") % 23 != 0, F.col("code_formatted"))
    return slices.sliced(carriers.spread(carriers.methods(spark, sf).select("id", code.alias("code"))), (0, 1, 2))


def _slices(spark, sf):
    return slices.sliced(carriers.spread(carriers.methods(spark, sf).select("id", F.col("code_formatted").alias("code"))), 1)


@query(f"SELECT p_partkey::VARCHAR AS id, 'Extract the constraints.\n\n' || 'Code Slice:\n' || {_SLICE(1)} || '\n' AS prompt FROM part")
def prompt_slice(spark, sf):
    return prompts.prompts(carriers.methods(spark, sf), TASK, slices=_slices(spark, sf), slice_only=True)


_TASKS = [("unst", "Reason step by step.\n\n"), ("woex", "Go through the parameters.\n\n"), ("expl", "Follow the steps and the example.\n\n"), ("exim", "Follow the steps and the cases.\n\n")]


@query(f"WITH {_METHODS} SELECT id, variant, task || 'Target Method:\n' || code_formatted || '\n' AS prompt FROM m, (VALUES {', '.join(f'{v}' for v in _TASKS)}) t(variant, task)".replace("\\n", "\n"))
def prompt_cot(spark, sf):
    return prompts.prompts_by_variant(carriers.methods(spark, sf), spark.createDataFrame(_TASKS, "variant string, task string"))


_HIGHLIGHT = "'\nCode Slice (highlights constraint-relevant statements):\n' || slice || '\n'"


@query(
    f"""WITH {_METHODS}, {_NEXT}, w AS (SELECT p_partkey::VARCHAR AS id, {_SLICE(1)} AS slice FROM part), same AS (SELECT code_formatted, min(id) AS first_id FROM m GROUP BY code_formatted),
 y AS (SELECT x.id, row_number() OVER (PARTITION BY x.id ORDER BY rank DESC) AS i, m.code_formatted, slice, m.doc_constraint FROM x JOIN m ON m.id = x.example_id JOIN same USING (code_formatted) JOIN w ON w.id = first_id WHERE x.id <> x.example_id),
 z AS (SELECT id, string_agg('\nExample ' || i || ':\nTarget Method:\n' || code_formatted || '\n' || {_HIGHLIGHT} || '\nOutput:\n(Step by step reasoning here)\nFinal expression: ' || doc_constraint || '\n', '' ORDER BY i) AS s FROM y GROUP BY id)
 SELECT m.id, 'Extract the constraints.\n\n' || coalesce('Few-Shot Examples:\n' || s || '\n----------------------------------------\n\nNow analyze the Target Method below:\n\n', '') || 'Target Method:\n' || code_formatted || '\n' || {_HIGHLIGHT} AS prompt FROM m LEFT JOIN z USING (id) JOIN w USING (id)"""
)
def prompt_mix(spark, sf):
    return prompts.mixed_prompts(carriers.methods(spark, sf), TASK, _examples(spark, sf), _slices(spark, sf), 3)


_VARIANTS = ", ".join("(%s)" % ", ".join("NULL" if v is None else repr(v).lower() if isinstance(v, bool) else repr(v) for v in x) for x in prompts.VARIANTS)


def _models(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_name").alias("model"), (F.col("s_suppkey") % 10 == 0).alias("is_benchmark"))


@query(
    f"""SELECT s_name AS model, strategy, variant, k, CASE WHEN k IS NOT NULL THEN variant || ' k=' || k WHEN variant IS NOT NULL THEN strategy || '-' || variant ELSE strategy END AS label,
 strategy || '/' || coalesce(variant || '/', '') || s_name || coalesce('_k' || k, '') || '.json' AS path FROM supplier, (VALUES {_VARIANTS}) v(strategy, variant, k, by_default) WHERE by_default OR s_suppkey % 10 = 0"""
)
def config_grid(spark, sf):
    return prompts.config_grid(_models(spark, sf), prompts.variants(spark))


def _registry(spark, sf):
    return table(spark, sf, "supplier").filter("s_suppkey % 7 <> 3").select(F.col("s_name").alias("model"), F.when(F.col("s_nationkey") % 2 == 0, "api").otherwise("local").alias("backend"))


@query("SELECT s_name AS model, s_suppkey % 10 = 0 AS is_benchmark, CASE WHEN s_nationkey % 2 = 0 THEN 'api' ELSE 'local' END AS backend FROM supplier WHERE s_suppkey % 7 <> 3")
def routed_models(spark, sf):
    return prompts.routed(_models(spark, sf), _registry(spark, sf))


@query("SELECT s_name AS model FROM supplier WHERE s_suppkey % 7 = 3")
def unknown_models(spark, sf):
    return prompts.unknown_models(_models(spark, sf), _registry(spark, sf))


_CHAINED = f"""k AS ({_topk(2, "< 0.9")}), n AS (SELECT vec_id, 'v' || vec_id AS id, 'code ' || vec_id AS code, 'label == ' || label AS gold FROM embeddings),
 y AS (SELECT k.id AS vec_id, row_number() OVER (PARTITION BY k.id ORDER BY rank DESC) AS i, code, gold FROM k JOIN n ON n.vec_id = example_id),
 z AS (SELECT vec_id, string_agg('\nExample ' || i || ':\nTarget Method:\n' || code || '\n\nOutput:\n' || gold || '\n', '' ORDER BY i) AS s FROM y GROUP BY vec_id)"""


@query(f"WITH {_CHAINED} SELECT n.id, 'Extract the constraints.\n\nFew-Shot Examples:\n' || s || '\n----------------------------------------\n\nNow analyze the Target Method below:\n\nTarget Method:\n' || code || '\n' AS prompt FROM n JOIN z USING (vec_id)")
def retrieved_prompts(spark, sf):
    """Retrieval, examples and prompts in one chain, over text ids."""
    e = table(spark, sf, "embeddings")
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    v = e.select(name.alias("id"), F.col("label").alias("project"), "embedding")
    items = e.select(name.alias("id"), F.concat(F.lit("code "), F.col("vec_id").cast("string")).alias("code_formatted"), F.concat(F.lit("label == "), F.col("label").cast("string")).alias("doc_constraint"))
    return prompts.prompts(items, TASK, prompts.example_sections(retrieval.similar_items(v, v, 2, 0.9), items, 2))


@query(f"SELECT p_partkey::VARCHAR AS id, {_BARE} AS code FROM part")
def strip_comments(spark, sf):
    return carriers.methods(spark, sf).select("id", C.without_empty_lines(C.without_comments(F.col("code_formatted"))).alias("code"))


@query("SELECT text AS code_formatted, min(doc_id) AS first_id FROM documents GROUP BY text")
def code_text_first_match(spark, sf):
    return prompts.first_of_same_code(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("code_formatted")))


@query("SELECT a.p_partkey, CASE WHEN greatest(length(a.p_name), length(b.p_name)) = 0 THEN 0.0 ELSE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name))::DOUBLE END AS similarity FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def lev_similarity(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    other = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(other, "p_partkey").select("p_partkey", C.text_similarity(F.col("p_name"), F.col("other")).alias("similarity"))


_OP = lambda c: "CASE %s %s END" % (c, " ".join(f"WHEN {k} THEN '{o}'" for k, o in enumerate(_OPS)))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN a = b THEN 1.0 {_OVERLAP_CASE} ELSE 0.0 END::DOUBLE AS similarity FROM (SELECT *, {_OP('l_linenumber % 6')} AS a, {_OP('l_partkey % 6')} AS b FROM lineitem)")
def operator_jaccard(spark, sf):
    of = lambda c: carriers.pick(_OPS, F.col(c))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", C.operator_overlap(of("l_linenumber"), of("l_partkey")).alias("similarity"))


_IDIOMS = {
    "v{}.isEmpty()": "(v{}.LEN == 0)",
    "!(v{}.isBlank())": "!((v{}.trim().LEN == 0))",
    "v{}.equals(w.get(i.sub(1)))": "(v{} == w.get(i.sub(1)))",
    "StringUtils.isEmpty(v{}) || size() > 0": "(v{} == null || (v{}.LEN == 0)) || this.LEN > 0",
    "v{} instanceof Map && v{}.length > 2": "v{}.TYPE == Map && v{}.LEN > 2",
    "(None)": "",
    'ArrayUtils.isEmpty(v{}) && "a".equals(b)': '(v{} == null || v{}.LEN == 0) && ("a" == b)',
}
_CANON = "CASE p_partkey %% 7 %s END" % " ".join("WHEN %d THEN '%s'" % (k, v.replace("{}", "' || p_size || '")) for k, v in enumerate(_IDIOMS.values()))


@query(f"SELECT p_partkey, {_CANON} AS canonical FROM part")
def canonical_idioms(spark, sf):
    said = F.regexp_replace(carriers.pick(list(_IDIOMS), F.col("p_partkey")), r"\{\}", F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", C.canonical(said).alias("canonical"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '12.5' ELSE 'v.f' || p_size || 'x' END AS operand FROM part")
def operand_forms(spark, sf):
    text = F.when(F.col("p_size") % 2 == 0, "12.500F").otherwise(F.concat(F.lit("v.f"), F.col("p_size").cast("string"), F.lit("x")))
    return table(spark, sf, "part").select("p_partkey", C.number_form(text).alias("operand"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 > p_size % 4 THEN 'parse_error: mismatched parentheses' WHEN p_partkey % 4 < p_size % 4 THEN 'parse_error: unmatched opening parenthesis' WHEN p_partkey % 5 = 0 THEN 'parse_error: trailing dangling operator' END AS error FROM part")
def paren_balance(spark, sf):
    text = F.concat(F.expr("repeat('(', p_size % 4)"), F.lit("a"), F.expr("repeat(')', cast(p_partkey % 4 as int))"), F.when(F.col("p_partkey") % 5 == 0, " &&").otherwise(""))
    return table(spark, sf, "part").select("p_partkey", C.format_error(text).alias("error"))


_TRIMMED = r"regexp_replace(text, '^[ \t\n\f\r]+|[ \t\n\f\r]+$', '', 'g')"


@query(
    rf"""SELECT conv_id, turn, s = '' OR regexp_matches(s, ';$|\bthrow\b|\.$|:$') OR regexp_matches(s, '^\s*\b(int|long|double|float|boolean|char|byte|short|String|Object|final|void)\b\s[\w\[\]<>]+\s*=')
 OR contains(regexp_replace(u, '[<>=!]=', '', 'g'), '=') OR regexp_matches(u, '\.\s+[A-Za-z]|^\s*(-\s|\*\s|\*\*|#>?|[A-Za-z]+:\s|\d+[\.\):]\s)')
 OR (regexp_matches(s, '\s') AND NOT regexp_matches(s, '&&|\|\||[<>=!]=?|[<>]|\binstanceof\b|[\w$.]+\s*\(')) AS rejected
 FROM (SELECT *, regexp_replace(s, '"[^"]*"', '', 'g') AS u FROM (SELECT conv_id, turn, {_TRIMMED} AS s FROM conversations))"""
)
def reject_prose(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", C.rejected(F.col("text")).alias("rejected"))


_SAID = f"""CASE WHEN (p_partkey + c) % 19 = 7 THEN 'None' ELSE CASE WHEN p_partkey % 7 = 1 THEN r || ' ' || {_list([MIRROR[o] for o in _OPS], "place")} || ' ' || l ELSE l || ' ' || {_list(_OPS, "place")} || ' ' || r END
 || CASE WHEN p_partkey % 4 = 0 THEN {_LINKED} || {_list(carriers.NAMES, "p_partkey + 1")} || '.length() ' || {_list(carriers.LENGTHS, "p_partkey + c")} ELSE '' END END"""


@query(
    f"""SELECT strategy, p_partkey::VARCHAR AS id, CASE WHEN p_partkey % 13 = 0 THEN 'The parameter must be valid.' WHEN strategy = 'cot' THEN {_SAID} || '\n\nThis is all.' ELSE {_SAID} END AS first FROM (
 SELECT *, p_size + (p_partkey + c) % 4 AS place, {_list(carriers.NAMES, "p_partkey + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END")} AS l, (p_size + (p_partkey + c) % 3)::VARCHAR AS r FROM part, {_CONFIG_SQL} WHERE p_partkey % 11 <> 0)"""
)
def marker_extract(spark, sf):
    return carriers.answers(spark, sf).select("strategy", "id", F.try_element_at(C.candidates(F.col("text")), F.lit(1)).alias("first"))


@query("SELECT DISTINCT event_type, regexp_matches(event_type, '^assert') AS asserting FROM events")
def asserting_names(spark, sf):
    return table(spark, sf, "events").select("event_type", C.asserting_call(F.col("event_type")).alias("asserting")).distinct()


# Significance: each user's largest value by event type.


def _values(spark, sf):
    e = table(spark, sf, "events").filter("value is not null")
    return e.groupBy((F.col("user_id") % 3).alias("grp"), F.col("event_type").alias("config"), F.col("user_id").alias("id")).agg(F.floor(F.max("value")).cast("double").alias("value"))


def _pairs(spark, sf):
    v = _values(spark, sf)
    return significance.paired(v, significance.pair_grid(v.select("grp", "config").distinct(), "grp"), "grp")


_VALUES = "v AS (SELECT user_id % 3 AS grp, event_type AS config, user_id AS id, floor(max(value))::DOUBLE AS value FROM events WHERE value IS NOT NULL GROUP BY ALL)"
_PAIRED = f"{_VALUES}, p AS (SELECT x.grp, x.config AS a, y.config AS b, x.id, x.value AS x, y.value AS y FROM v x JOIN v y ON x.grp = y.grp AND x.id = y.id AND x.config < y.config)"


@query(f"WITH {_VALUES} SELECT DISTINCT x.grp, x.config AS a, y.config AS b FROM v x JOIN v y ON x.grp = y.grp AND x.config < y.config")
def pair_grid(spark, sf):
    return significance.pair_grid(_values(spark, sf).select("grp", "config").distinct(), "grp")


_DELTA = f"WITH {_PAIRED} SELECT q.grp, q.a, q.b, sum(sign(q.x - r.y))::DOUBLE / count(*) AS delta FROM p q JOIN p r ON q.grp = r.grp AND q.a = r.a AND q.b = r.b GROUP BY ALL"


@query(_DELTA)
def cliffs_delta(spark, sf):
    return significance.cliffs_delta(_pairs(spark, sf), "grp", "a", "b")


@query(f"SELECT grp, a, b, CASE WHEN abs(delta) < 0.147 THEN 'Negligible' WHEN abs(delta) < 0.33 THEN 'Small' WHEN abs(delta) < 0.474 THEN 'Medium' ELSE 'Large' END AS effect FROM ({_DELTA})")
def effect_label(spark, sf):
    return cliffs_delta(spark, sf).select("grp", "a", "b", C.effect_label(F.col("delta")).alias("effect"))


@query(
    f"""WITH {_PAIRED}, r AS (SELECT *, rank() OVER (PARTITION BY grp, a, b ORDER BY abs(x - y)) + (count(*) OVER (PARTITION BY grp, a, b, abs(x - y)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY grp, a, b, abs(x - y))::DOUBLE AS t FROM p),
 w AS (SELECT grp, a, b, count(*) AS n, sum(CASE WHEN x > y THEN r WHEN x = y THEN r / 2 ELSE 0 END) AS up, sum(CASE WHEN x < y THEN r WHEN x = y THEN r / 2 ELSE 0 END) AS down, sum(t * t - 1) AS ties FROM r GROUP BY ALL)
 SELECT grp, a, b, n, least(up, down) AS statistic, round((least(up, down) - n * (n + 1) / 4.0) / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - ties / 2) / 24), 9) AS z FROM w"""
)
def wilcoxon_z(spark, sf):
    return significance.wilcoxon(_pairs(spark, sf), "grp", "a", "b").withColumn("z", F.round("z", 9))


@query(
    f"""WITH {_VALUES}, k AS (SELECT grp, count(DISTINCT config) AS k FROM v GROUP BY grp),
 h AS (SELECT v.*, k, rank() OVER (PARTITION BY v.grp, id ORDER BY value) + (count(*) OVER (PARTITION BY v.grp, id, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY v.grp, id) AS held, count(*) OVER (PARTITION BY v.grp, id, value)::DOUBLE AS t FROM v JOIN k USING (grp)),
 s AS (SELECT grp, config, k::DOUBLE AS k, sum(r) AS s, count(*)::DOUBLE AS n, sum(t * t - 1) AS t FROM h WHERE held = k GROUP BY ALL),
 f AS (SELECT grp, k, max(n) AS n, sum(s * s) AS q, sum(t) AS t FROM s GROUP BY ALL)
 SELECT grp, n::BIGINT AS n, k::BIGINT AS groups, round((12 / (n * k * (k + 1)) * q - 3 * n * (k + 1)) / (1 - t / (n * k * (k * k - 1))), 9) AS chi2, (k - 1)::BIGINT AS df FROM f"""
)
def friedman_chi2(spark, sf):
    return significance.friedman(_values(spark, sf), "grp").withColumn("chi2", F.round("chi2", 9))


_P = "t AS (SELECT p_partkey, p_brand, (p_size + (p_partkey % 10) / 10.0::DOUBLE) / 2000.0 AS p FROM part)"


def _tests(spark, sf):
    return table(spark, sf, "part").select("p_partkey", "p_brand", ((F.col("p_size") + (F.col("p_partkey") % 10) / 10.0) / 2000.0).alias("p"))


@query(f"WITH {_P}, i AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS i, count(*) OVER (PARTITION BY p_brand) AS m FROM t) SELECT p_partkey, least(1.0::DOUBLE, max((m - i + 1) * p) OVER (PARTITION BY p_brand ORDER BY i)) AS p_corr FROM i")
def holm_adjust(spark, sf):
    return significance.corrected(_tests(spark, sf), "p", "p_brand").select("p_partkey", "p_corr")


@query(f"WITH {_P}, i AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS i, count(*) OVER (PARTITION BY p_brand) AS m FROM t) SELECT p_partkey, least(1.0::DOUBLE, min(m::DOUBLE / i * p) OVER (PARTITION BY p_brand ORDER BY i DESC)) AS p_corr FROM i")
def bh_adjust(spark, sf):
    return significance.corrected(_tests(spark, sf), "p", "p_brand", method="bh").select("p_partkey", "p_corr")


_ERF = "CASE WHEN {0} = 0 THEN 0.0 WHEN {0} > 6 THEN 1.0 ELSE exp(-{0} * {0}) * (SELECT sum(exp((2 * n + 1) * ln({0}) - lgamma(n + 1.5))) FROM range(200) t(n)) END"
_SIGNIFICANT = f"""{_SCORED}, {_VALUES}, f AS (SELECT 'strict' AS metric, config, id, strict_f1 AS value FROM s UNION ALL SELECT 'relaxed', config, id, relaxed_f1 FROM s WHERE config IN ('vanilla', 'mix') UNION ALL SELECT 'events ' || grp, config, id::VARCHAR, value FROM v),
p AS (SELECT x.metric, x.config AS a, y.config AS b, x.id, x.value AS x, y.value AS y FROM f x JOIN f y ON x.metric = y.metric AND x.id = y.id AND x.config < y.config),
r AS (SELECT *, rank() OVER (PARTITION BY metric, a, b ORDER BY abs(x - y)) + (count(*) OVER (PARTITION BY metric, a, b, abs(x - y)) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY metric, a, b, abs(x - y))::DOUBLE AS t FROM p),
w AS (SELECT metric, a, b, count(*) AS n, round(avg(x), 4) AS mean_a, round(avg(y), 4) AS mean_b, sum(CASE WHEN x > y THEN r WHEN x = y THEN r / 2 ELSE 0 END) AS up, sum(CASE WHEN x < y THEN r WHEN x = y THEN r / 2 ELSE 0 END) AS down, sum(t * t - 1) AS ties FROM r GROUP BY ALL),
z AS (SELECT *, (least(up, down) - n * (n + 1) / 4.0) / sqrt((n::DOUBLE * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM w),
e AS (SELECT *, abs(z) / sqrt(2::DOUBLE) AS u FROM z),
q AS (SELECT e.*, 1 - {_ERF.format("u")} AS p_raw FROM e),
side AS (SELECT metric, a, b, x AS v, 1 AS nx, 0 AS ny FROM p UNION ALL SELECT metric, a, b, y, 0, 1 FROM p),
vals AS (SELECT metric, a, b, v, sum(nx) AS nx, sum(ny) AS ny FROM side GROUP BY ALL),
below AS (SELECT *, coalesce(sum(ny) OVER (PARTITION BY metric, a, b ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower, sum(ny) OVER (PARTITION BY metric, a, b) AS all_y FROM vals),
delta AS (SELECT metric, a, b, sum(nx * (lower - (all_y - lower - ny)))::DOUBLE / (sum(nx) * max(all_y)) AS delta FROM below GROUP BY ALL),
k AS (SELECT metric, count(DISTINCT config) AS k FROM f GROUP BY metric),
h AS (SELECT f.*, k, rank() OVER (PARTITION BY f.metric, id ORDER BY value) + (count(*) OVER (PARTITION BY f.metric, id, value) - 1) / 2.0::DOUBLE AS r, count(*) OVER (PARTITION BY f.metric, id) AS held, count(*) OVER (PARTITION BY f.metric, id, value)::DOUBLE AS t FROM f JOIN k USING (metric)),
g AS (SELECT metric, config, k::DOUBLE AS k, sum(r) AS s, count(*)::DOUBLE AS n, sum(t * t - 1) AS t FROM h WHERE held = k GROUP BY ALL),
c2 AS (SELECT metric, k, (12 / (max(n) * k * (k + 1)) * sum(s * s) - 3 * max(n) * (k + 1)) / (1 - sum(t) / (max(n) * k * (k * k - 1))) AS chi2 FROM g GROUP BY metric, k),
m AS (SELECT q.*, delta, k, chi2, row_number() OVER (PARTITION BY metric ORDER BY p_raw) AS i, count(*) OVER (PARTITION BY metric) AS tests FROM q JOIN delta USING (metric, a, b) JOIN c2 USING (metric)),
told AS (SELECT *, CASE WHEN k > 2 THEN least(1.0, max((tests - i + 1) * p_raw) OVER (PARTITION BY metric ORDER BY i)) ELSE p_raw END AS p_corr, CASE WHEN k > 2 THEN round(delta, 4) ELSE delta END AS d FROM m)"""


@query(
    f"""WITH {_SIGNIFICANT} SELECT metric, a, b, n, mean_a, mean_b, round(z, 6) AS z, round(p_raw, 6) AS p_raw, round(p_corr, 6) AS p_corr, p_corr < 0.05 AS significant, round(delta, 6) AS delta,
 CASE WHEN abs(d) < 0.147 THEN 'Negligible' WHEN abs(d) < 0.33 THEN 'Small' WHEN abs(d) < 0.474 THEN 'Medium' ELSE 'Large' END AS effect, k::BIGINT AS groups,
 CASE WHEN k > 2 THEN round(chi2, 6) END AS chi2, CASE WHEN k > 2 THEN round(exp(-chi2 / 2) * (1 + chi2 / 2), 6) END AS p_global FROM told"""
)
def significance_table(spark, sf):
    """All pairs of configurations of the scored answers, per metric; one metric has two configurations."""
    return _significance(spark, sf).select("metric", "a", "b", "n", "mean_a", "mean_b", *(F.round(c, 6).alias(c) for c in ("z", "p_raw", "p_corr")), "significant", F.round("delta", 6).alias("delta"), "effect", "groups", *(F.round(c, 6).alias(c) for c in ("chi2", "p_global")))


def _significance(spark, sf):
    m = evaluation.metrics(carriers.methods(spark, sf), carriers.answers(spark, sf))
    scores = m.select("config", "id", F.explode(F.create_map(F.lit("strict"), "strict_f1", F.lit("relaxed"), "relaxed_f1")).alias("metric", "value")).filter("metric = 'strict' or config in ('vanilla', 'mix')")
    by_user = _values(spark, sf).select(F.concat(F.lit("events "), "grp").alias("metric"), "config", F.col("id").cast("string").alias("id"), "value")
    return evaluation.significance(scores.unionByName(by_user), ["metric"])


_FIRST = "CASE metric WHEN 'strict' THEN '01' WHEN 'relaxed' THEN '02' ELSE '99' END"
_LABEL = "CASE metric WHEN 'strict' THEN 'Strict F1' WHEN 'relaxed' THEN 'Relaxed F1' ELSE metric END"


def _row(place: str, **cells: str) -> str:
    return f"SELECT section, {place} AS place, " + ", ".join(f"{cells.get(c, chr(39) * 2)} AS {c}" for c in evaluation.EXPORTED)


_ROWS = " UNION ALL ".join(
    [
        _row("''", model="'m'", analysis="section", n="max(n)::VARCHAR", groups="max(k)::BIGINT::VARCHAR", correction="'HOLM'") + " FROM named GROUP BY section",
        _row(
            f"{_FIRST} || '|' || metric || '|1'",
            metric=_LABEL,
            comparison="CASE WHEN max(k) > 2 THEN 'Friedman (global)' ELSE 'Wilcoxon signed-rank (global)' END",
            p_raw="printf('%.6f', max(p_all))",
            significant="(max(p_all) < 0.05)::VARCHAR",
            chi2="coalesce(printf('%.4f', max(CASE WHEN k > 2 THEN chi2 END)), '')",
        )
        + " FROM named GROUP BY section, metric",
        _row(
            f"{_FIRST} || '|' || metric || '|2|' || a || '|' || b",
            metric=_LABEL,
            comparison="a || ' vs ' || b",
            **{c: f"printf('%.4f', {c})" for c in ("mean_a", "mean_b")},
            **{c: f"printf('%.6f', {c})" for c in ("p_raw", "p_corr")},
            significant="(p_corr < 0.05)::VARCHAR",
            delta="printf('%.4f', round(delta, 4))",
            effect="CASE WHEN abs(d) < 0.147 THEN 'Negligible' WHEN abs(d) < 0.33 THEN 'Small' WHEN abs(d) < 0.474 THEN 'Medium' ELSE 'Large' END",
        )
        + " FROM named",
        _row(f"{_FIRST} || '|' || metric || '|3'") + " FROM named GROUP BY section, metric",
    ]
)


@query(f"WITH {_SIGNIFICANT}, named AS (SELECT *, split_part(metric, ' ', 1) AS section, CASE WHEN k > 2 THEN exp(-chi2 / 2) * (1 + chi2 / 2) ELSE p_raw END AS p_all FROM told) SELECT * EXCLUDE (place), (row_number() OVER (PARTITION BY section ORDER BY place))::INT AS row_no FROM ({_ROWS})")
def significance_export(spark, sf):
    """The same as a report with sections, numbers to fixed digits."""
    tests = _significance(spark, sf).withColumn("analysis", F.split("metric", " ")[0])
    report = evaluation.sectioned(tests, "analysis", model="m")
    to = lambda c, n: F.when(F.col(c) == "", "").otherwise(F.format_string(f"%.{n}f", F.col(c).cast("double")))
    return report.withColumns({c: to(c, n) for c, n in {"mean_a": 4, "mean_b": 4, "p_raw": 6, "p_corr": 6, "delta": 4, "chi2": 4}.items()})


_REPORT = "r AS (SELECT true AS is_mean, 'mean' AS c_name, printf('%.3f', avg(c_acctbal)) AS c_acctbal FROM customer UNION ALL SELECT false, c_name, CASE WHEN c_custkey % 10 = 0 THEN 'NaN' WHEN c_custkey % 10 = 1 THEN 'n/a' ELSE printf('%.5f', c_acctbal) END FROM customer)"


@query(f"WITH {_REPORT} SELECT c_name, try_cast(c_acctbal AS DOUBLE) AS c_acctbal FROM r WHERE NOT is_mean AND c_acctbal NOT IN ('NaN', 'n/a')")
def report_scan(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    report = metrics.with_mean_row(c, "c_name", "c_acctbal").join(c.select("c_name", "c_custkey"), "c_name", "left")
    cell = F.when(F.col("c_custkey") % 10 == 0, "NaN").when(F.col("c_custkey") % 10 == 1, "n/a").otherwise(F.col("c_acctbal"))
    return metrics.scores_from_report(report.withColumn("c_acctbal", cell), "c_name", "c_acctbal")


@query("SELECT conv_id, turn, prompt, answer FROM (SELECT conv_id, turn, role, text AS prompt, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'")
def replay_turns(spark, sf):
    return inference.replayed_turns(table(spark, sf, "conversations"))


@query(f"WITH {_METHODS} SELECT id, CASE WHEN id::BIGINT % 11 = 0 THEN 'no recorded answer' END AS error FROM m")
def replay_infer(spark, sf):
    recorded = carriers.answers(spark, sf).filter("strategy = 'fewshot'").select("id", "text", "error")
    return inference.replayed(prompts.prompts(carriers.methods(spark, sf), TASK), recorded).select("id", "error")


@query("SELECT strategy, config AS label, count(*) AS n FROM part, " + _CONFIG_SQL + " WHERE p_partkey % 11 <> 0 GROUP BY ALL")
def config_labels(spark, sf):
    return carriers.answers(spark, sf).select("strategy", prompts.label(F.col("strategy"), F.col("variant"), F.col("k")).alias("label")).groupBy("strategy", "label").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN 'x > ' || p_size ELSE '' END AS expression, p_size AS wit_path_count, (p_size % 3 = 0)::INT AS none_pct, (p_size * 800 > 30000)::INT AS shortened FROM part")
def baseline_flags(spark, sf):
    said = carriers.pick(["", "true", "simplify_error: x", "x"], F.col("p_size"))
    p = table(spark, sf, "part").select(
        "p_partkey",
        F.when(said == "x", F.concat(F.lit("x > "), F.col("p_size").cast("string"))).otherwise(said).alias("wit_result"),
        F.expr("transform(sequence(1, p_size), i -> repeat('p', 797))").alias("wit_paths"),
        F.when(F.col("p_size") % 3 == 0, "timeout").alias("miss_reason"),
    )
    return metrics.baseline_scored(p).select("p_partkey", "expression", "wit_path_count", "none_pct", F.col("wit_paths_text").endswith("...").cast("int").alias("shortened"))
