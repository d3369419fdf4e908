"""Queries over the driver's tables, each with SQL that gives the same rows.

The tables hold no logs, so log lines are made of them: of ``events`` (a line an event, the
days of the month in three runs), and of ``documents`` line by line for the maskers.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.config import SIGNIFICANCE
from driftlens.functions import masks as M
from driftlens.functions import patterns as P
from driftlens.functions import text as T
from driftlens.functions.scoring import count_g_test, flakiness_penalty, g_test
from driftlens.operators import blocks as B
from driftlens.operators import compare as C
from driftlens.operators import fields as W
from driftlens.operators import pages
from driftlens.operators.lineage import durable
from driftlens.operators.mining import mine, templates
from driftlens.sources.lines import losses, lost, numbered

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- log views

_RUN = "CASE WHEN day(ts) <= 10 THEN 0 WHEN day(ts) <= 20 THEN 1 ELSE 2 END"


def _numbered(events: DataFrame) -> DataFrame:
    """run_idx, line_no and raw of events (run_idx, event_id, raw), lines in the order of ids."""
    return numbered(events.select("run_idx", "raw", F.floor(F.col("event_id") / 65536).alias("_split"), F.col("event_id").alias("_place")))


def plain_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line an event, all in three runs."""
    e = _table(spark, sf_dir, "events")
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(" "), "event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" value "), F.round(F.col("value") * 100).cast("long").cast("string"), F.lit(" "), "props")
    return _numbered(e.select(F.expr(_RUN).alias("run_idx"), "event_id", raw.alias("raw")))


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in runs that differ: signup is new, error is gone, click is rarer (they are views instead), view fails at times, purchase misses svc-3."""
    e = _table(spark, sf_dir, "events").withColumn("run_idx", F.expr(_RUN)).withColumn("event_type", F.expr(_KIND_OF))
    raw = F.concat(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit(" "), "event_type", F.lit(" user "), F.col("user_id").cast("string"), F.lit(" state "), F.expr(_STATE),
        F.lit(" on svc-"), F.expr(_SVC).cast("string"), F.lit(" value "), F.round(F.col("value") * 100).cast("long").cast("string"),
    )
    return _numbered(e.select("run_idx", "event_id", raw.alias("raw")))


_KIND_OF = "CASE WHEN (event_type = 'signup' AND run_idx < 2) OR (event_type = 'error' AND run_idx = 2) OR (event_type = 'click' AND run_idx = 2 AND event_id % 10 <> 0) THEN 'view' ELSE event_type END"
_STATE = "CASE WHEN event_type = 'view' AND run_idx = 2 AND event_id % 3 = 0 THEN 'failed' ELSE 'ok' END"
_SVC = "CASE WHEN event_type = 'purchase' AND run_idx = 2 THEN event_id % 3 ELSE event_id % 4 END"
_SQL_LINES = f"""
    e AS (SELECT * REPLACE ({_KIND_OF} AS event_type) FROM (SELECT *, {_RUN} AS run_idx FROM events)),
    l AS (SELECT *, {_STATE} AS state, {_SVC} AS svc, row_number() OVER (PARTITION BY run_idx ORDER BY event_id) AS line_no FROM e),
    kinds AS (SELECT event_type, count(*) FILTER (WHERE run_idx = 0) AS c0, count(*) FILTER (WHERE run_idx = 1) AS c1, count(*) FILTER (WHERE run_idx = 2) AS tc,
                     event_type || ' user <*> state ' || CASE WHEN count(DISTINCT state) > 1 THEN '<*>' ELSE min(state) END || ' on <*> value <*>' AS template,
                     min(line_no) FILTER (WHERE run_idx = 2) AS first_target_line_no, min(line_no) FILTER (WHERE run_idx = 0) AS first_baseline
              FROM l GROUP BY event_type),
    totals AS (SELECT count(*) FILTER (WHERE run_idx = 0) AS t0, count(*) FILTER (WHERE run_idx = 1) AS t1, count(*) FILTER (WHERE run_idx = 2) AS tt FROM l)
"""


def _sql_g(a: str, at: str, c: str, ct: str) -> str:
    o = [f"({a} + 0.5)", f"({at} - {a} + 0.5)", f"({c} + 0.5)", f"({ct} - {c} + 0.5)"]
    rows, cols = [f"({o[0]} + {o[1]})", f"({o[2]} + {o[3]})"], [f"({o[0]} + {o[2]})", f"({o[1]} + {o[3]})"]
    n = f"({rows[0]} + {rows[1]})"
    return "2.0 * (" + " + ".join(f"{x} * ln({x} / ({rows[i // 2]} * {cols[i % 2]} / CAST({n} AS DOUBLE)))" for i, x in enumerate(o)) + ")"


def _sql_count_g(c0: str, c1: str, t: str) -> str:
    return f"2.0 * (CASE WHEN {c0} + {c1} > 0 THEN ({c0} + {c1}) * ln(({c0} + {c1}) / (({c0} + {c1} + {t}) * 2.0 / 3.0)) ELSE 0 END + CASE WHEN {t} > 0 THEN {t} * ln({t} / (({c0} + {c1} + {t}) / 3.0)) ELSE 0 END)"


def _sql_penalty(r0: str, r1: str) -> str:
    mean = f"(({r0} + {r1}) / 2.0)"
    return f"CASE WHEN {mean} <= 0 THEN 1.0 ELSE 1.0 + 2.0 * sqrt((({r0} - {mean}) * ({r0} - {mean}) + ({r1} - {mean}) * ({r1} - {mean})) / 2.0) / {mean} END"


_R0, _R1 = "(c0 / CAST(t0 AS DOUBLE))", "(c1 / CAST(t1 AS DOUBLE))"
_SCORE = f"({_sql_g('(c0 + c1)', '(t0 + t1)', 'tc', 'tt')}) / ({_sql_penalty(_R0, _R1)})"


def _counts(spark, sf_dir):
    mined = mine(changed_lines(spark, sf_dir))
    return mined, durable(C.counted(mined, 2))


# ---------------------------------------------------------------- mining

_SQL_PLAIN = f"""
    p AS (SELECT event_type, CAST(user_id AS VARCHAR) AS u, CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS v, regexp_extract(props, ': (.*)$', 1) AS k, {_RUN} AS run_idx, event_id,
                 row_number() OVER (PARTITION BY {_RUN} ORDER BY event_id) AS line_no FROM events),
    q AS (SELECT *, regexp_replace(u, '^[0-9]{{4,}}$', '<NUM>') AS mu, regexp_replace(v, '^[0-9]{{4,}}$', '<NUM>') AS mv FROM p),
    t AS (SELECT event_type, count(*) AS n, min(run_idx * 1000000000000 + line_no) AS ord, arg_min(line_no, run_idx * 1000000000000 + line_no) AS first_line_no,
                 [event_type, 'user', CASE WHEN count(DISTINCT mu) = 1 THEN min(mu) ELSE '<*>' END, 'value', CASE WHEN count(DISTINCT mv) = 1 THEN min(mv) ELSE '<*>' END, '{{"k":', CASE WHEN count(DISTINCT k) = 1 THEN min(k) ELSE '<*>' END] AS tokens
          FROM q GROUP BY event_type),
    c AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS cid FROM t)
"""


@query("templates_topn", f"WITH {_SQL_PLAIN} SELECT cid, array_to_string(tokens, ' ') AS template, n AS count, first_line_no FROM c ORDER BY n DESC, cid LIMIT 20")
def templates_topn(spark, sf_dir):
    return templates(plain_lines(spark, sf_dir), 20).select("cid", "template", "count", "first_line_no")


@query("template_tokens", f"WITH {_SQL_PLAIN} SELECT cid, unnest(range(7)) AS pos, unnest(tokens) AS token FROM c")
def template_tokens(spark, sf_dir):
    return mine(plain_lines(spark, sf_dir)).clusters.select("cid", F.posexplode("template_tokens").alias("pos", "token")).select("cid", F.col("pos").cast("long").alias("pos"), "token")


@query("line_templates", f"WITH {_SQL_PLAIN} SELECT q.run_idx, q.line_no, c.cid FROM q JOIN c ON q.event_type = c.event_type")
def line_templates(spark, sf_dir):
    return mine(plain_lines(spark, sf_dir)).assigned.select("run_idx", "line_no", "cid")


@query("cluster_counts", f"WITH {_SQL_LINES} SELECT template, c0, c1, tc FROM kinds")
def cluster_counts(spark, sf_dir):
    return _counts(spark, sf_dir)[1].select("template", "c0", "c1", "tc")


# ---------------------------------------------------------------- scores

_PER_TYPE = f"WITH e AS (SELECT *, {_RUN} AS run_idx FROM events), k AS (SELECT event_type, count(*) FILTER (WHERE run_idx = 0) AS c0, count(*) FILTER (WHERE run_idx = 1) AS c1, count(*) FILTER (WHERE run_idx = 2) AS tc FROM e GROUP BY event_type), t AS (SELECT sum(c0) AS t0, sum(c1) AS t1, sum(tc) AS tt FROM k)"


def _per_type(spark, sf_dir):
    e = _table(spark, sf_dir, "events").withColumn("run_idx", F.expr(_RUN))
    k = e.groupBy("event_type").agg(*[F.count_if(F.col("run_idx") == i).alias(c) for i, c in enumerate(("c0", "c1", "tc"))])
    t = k.agg(F.sum("c0").alias("t0"), F.sum("c1").alias("t1"), F.sum("tc").alias("tt"))
    return k.join(F.broadcast(t))  # one row


@query("g_test", f"{_PER_TYPE} SELECT event_type, round({_sql_g('(c0 + c1)', '(t0 + t1)', 'tc', 'tt')}, 6) AS g FROM k, t")
def q_g_test(spark, sf_dir):
    return _per_type(spark, sf_dir).select("event_type", F.round(g_test(F.col("c0") + F.col("c1"), F.col("t0") + F.col("t1"), F.col("tc"), F.col("tt")), 6).alias("g"))


@query("count_g_test", f"{_PER_TYPE} SELECT event_type, round({_sql_count_g('c0', 'c1', 'tc')}, 6) AS g FROM k, t")
def q_count_g_test(spark, sf_dir):
    return _per_type(spark, sf_dir).select("event_type", F.round(count_g_test([F.col("c0"), F.col("c1")], F.col("tc")), 6).alias("g"))


@query("flakiness_penalty", f"{_PER_TYPE} SELECT event_type, round({_sql_penalty(_R0, _R1)}, 6) AS penalty FROM k, t")
def q_flakiness(spark, sf_dir):
    rates = [F.col("c0") / F.col("t0"), F.col("c1") / F.col("t1")]
    return _per_type(spark, sf_dir).select("event_type", F.round(flakiness_penalty(rates), 6).alias("penalty"))


# ---------------------------------------------------------------- findings

_COUNTED_AS = f"{_sql_count_g('c0', 'c1', 'tc')} >= {SIGNIFICANCE}"
_KIND = f"""CASE WHEN tc > 0 AND c0 + c1 = 0 THEN 'new' WHEN tc = 0 AND c0 > 0 AND c1 > 0 THEN 'gone'
    WHEN {_SCORE} >= {SIGNIFICANCE} AND {_COUNTED_AS} AND sign(tc / CAST(tt AS DOUBLE) - (c0 + c1) / CAST(t0 + t1 AS DOUBLE)) = sign(tc * 2 - (c0 + c1)) THEN 'changed' END"""


def _findings(spark, sf_dir):
    mined, counts = _counts(spark, sf_dir)
    return C.findings(counts, C.run_totals(mined, 3), 2, SIGNIFICANCE)


def _finding_query(kind: str):
    line = "first_baseline" if kind == "gone" else "first_target_line_no"
    column = "first_baseline_line_no" if kind == "gone" else "first_target_line_no"

    @query(f"diff_{kind}", f"WITH {_SQL_LINES} SELECT template, round({_SCORE}, 6) AS score, c0, c1, tc, {line} AS line_no FROM kinds, totals WHERE {_KIND} = '{kind}'")
    def run(spark, sf_dir):
        c = F.col("baseline_counts")
        return _findings(spark, sf_dir).where(F.col("kind") == kind).select("template", F.round("score", 6).alias("score"), F.get(c, F.lit(0)).alias("c0"), F.get(c, F.lit(1)).alias("c1"), F.col("target_count").alias("tc"), F.col(column).alias("line_no"))


for _k in ("new", "gone", "changed"):
    _finding_query(_k)


@query("diff_summary", f"WITH {_SQL_LINES}, k AS (SELECT {_KIND} AS kind, tc * 2 - (c0 + c1) AS d FROM kinds, totals) SELECT kind, CASE WHEN d > 0 THEN 'up' WHEN d < 0 THEN 'down' ELSE 'flat' END AS direction, count(*) AS n FROM k WHERE kind IS NOT NULL GROUP BY ALL")
def diff_summary(spark, sf_dir):
    return _findings(spark, sf_dir).groupBy("kind", "direction").agg(F.count("*").alias("n"))


def _tracked(spark, sf_dir):
    mined, counts = _counts(spark, sf_dir)
    return mined, counts, durable(C.tracked(mined, counts, 2))


@query("new_values", f"""WITH {_SQL_LINES}, v AS (SELECT event_type, state, count(*) FILTER (WHERE run_idx < 2) AS b, count(*) FILTER (WHERE run_idx = 2) AS t, min(line_no) FILTER (WHERE run_idx = 2) AS line FROM l GROUP BY ALL)
    SELECT k.template, CAST(4 AS INTEGER) AS position, v.state AS new_value, (SELECT string_agg(w.state, ',' ORDER BY w.state) FROM v w WHERE w.event_type = v.event_type AND w.b > 0) AS baseline_values,
           v.line AS first_target_line_no, round((k.c0 + k.c1) / (SELECT CAST(count(*) AS DOUBLE) FROM v w WHERE w.event_type = v.event_type AND w.b > 0), 6) AS established
    FROM v JOIN kinds k ON k.event_type = v.event_type WHERE v.b = 0 AND k.tc > 0 AND k.c0 + k.c1 > 0""")
def new_values(spark, sf_dir):
    _, counts, tracked = _tracked(spark, sf_dir)
    return C.new_values(tracked, counts, 2).select("template", "position", "new_value", F.array_join("baseline_values", ",").alias("baseline_values"), "first_target_line_no", F.round("established", 6).alias("established"))


@query("gone_values", f"""WITH {_SQL_LINES}, v AS (SELECT event_type, svc, count(*) FILTER (WHERE run_idx = 0) AS v0, count(*) FILTER (WHERE run_idx = 1) AS v1, count(*) FILTER (WHERE run_idx = 2) AS t, min(line_no) FILTER (WHERE run_idx = 0) AS line FROM l GROUP BY ALL)
    SELECT replace(template, 'on <*>', 'on svc-' || svc) AS template, v0 AS c0, v1 AS c1, line AS line_no FROM v JOIN kinds k ON k.event_type = v.event_type, totals
    WHERE v.t = 0 AND k.tc > 0 AND v0 > 0 AND least(v0 / CAST(k.c0 AS DOUBLE), v1 / CAST(k.c1 AS DOUBLE)) * k.tc >= 8""")
def gone_values(spark, sf_dir):
    mined, counts, tracked = _tracked(spark, sf_dir)
    c = F.col("baseline_counts")
    return C.gone_values(tracked, counts, C.run_totals(mined, 3), 2).select("template", F.get(c, F.lit(0)).alias("c0"), F.get(c, F.lit(1)).alias("c1"), F.col("first_baseline_line_no").alias("line_no"))


# ---------------------------------------------------------------- blocks and context

#: Types whose lines count as new.
_NEW_TYPES = "event_type IN ('signup', 'error')"
_NEW_SQL = f"n AS (SELECT event_id + 1 AS line_no, event_id // 40 * 2 + event_id % 2 AS cid FROM events WHERE {_NEW_TYPES}), g AS (SELECT *, line_no - lag(line_no) OVER (ORDER BY line_no) AS gap FROM n), r AS (SELECT line_no, cid, max(CASE WHEN gap IS NULL OR gap > 3 THEN line_no END) OVER (ORDER BY line_no) AS run FROM g)"


def _new_lines(spark, sf_dir):
    e = _table(spark, sf_dir, "events").where(_NEW_TYPES)
    return e.select((F.col("event_id") + 1).alias("line_no"), F.expr("event_id div 40 * 2 + event_id % 2").alias("cid"))


@query("new_runs", f"WITH {_NEW_SQL} SELECT line_no, cid, run FROM r")
def new_runs(spark, sf_dir):
    return B.new_runs(_new_lines(spark, sf_dir))


@query("new_blocks", f"""WITH {_NEW_SQL}, s AS (SELECT run, min(line_no) AS first, max(line_no) AS last FROM r GROUP BY run HAVING count(DISTINCT cid) >= 2),
    c AS (SELECT cid, count(*) AS n, count(s.run) AS inside, arg_min(r.run, r.line_no) AS home FROM r LEFT JOIN s ON s.run = r.run GROUP BY cid), f AS (SELECT * FROM c WHERE n = inside),
    m AS (SELECT home AS run, count(*) AS members FROM f GROUP BY home HAVING count(*) >= 2),
    x AS (SELECT f.home AS run, count(*) FILTER (WHERE r.run <> f.home) AS lines_elsewhere FROM r JOIN f ON f.cid = r.cid GROUP BY f.home)
    SELECT s.run, s.first, s.last, m.members, x.lines_elsewhere FROM s JOIN m ON m.run = s.run JOIN x ON x.run = s.run""")
def new_blocks(spark, sf_dir):
    return B.new_blocks(B.new_runs(_new_lines(spark, sf_dir))).select("run", "first", "last", F.size("members").cast("long").alias("members"), "lines_elsewhere")


_EXTENTS = "event_id AS cid, event_id * 2 AS first, event_id * 2 + user_id % 7 AS last, 1 + user_id % 3 AS count"


@query("gone_chains", f"""WITH e AS (SELECT {_EXTENTS} FROM events), c AS (SELECT *, CASE WHEN 2 * count >= last - first + 1 THEN last ELSE first END AS covered FROM e),
    w AS (SELECT *, max(covered) OVER (ORDER BY first, cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c)
    SELECT cid, first, last, covered, count(*) FILTER (WHERE reach IS NULL OR first > reach + 3) OVER (ORDER BY first, cid) AS chain FROM w""")
def gone_chains(spark, sf_dir):
    e = _table(spark, sf_dir, "events").selectExpr(*_EXTENTS.split(", "))
    packed = 2 * F.col("count") >= F.col("last") - F.col("first") + 1
    e = e.withColumn("covered", F.when(packed, F.col("last")).otherwise(F.col("first")))
    return B.gone_chains(e).select("cid", "first", "last", "covered", "chain")


_SPARSE = "event_id AS cid, event_id * 11 + user_id % 9 AS first, event_id * 11 + user_id % 9 + user_id % 5 AS last, 1 + user_id % 4 AS count"


@query("joined_chains", f"""WITH RECURSIVE e AS (SELECT {_SPARSE} FROM events), x AS (SELECT *, 2 * count >= last - first + 1 AS packed FROM e),
    c AS (SELECT cid, first, CASE WHEN packed THEN last ELSE first END AS covered, CASE WHEN packed THEN count ELSE 1 END AS placed FROM x),
    w AS (SELECT *, max(covered) OVER (ORDER BY first, cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c),
    n AS (SELECT *, count(*) FILTER (WHERE reach IS NULL OR first > reach + 3) OVER (ORDER BY first, cid) AS chain FROM w),
    g AS (SELECT chain, min(first) AS f, max(covered) AS t, CAST(sum(placed) AS BIGINT) AS p FROM n GROUP BY chain),
    h AS (SELECT *, max(t) OVER (ORDER BY chain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM g),
    k AS (SELECT *, count(*) FILTER (WHERE reach IS NULL OR f > reach + 17) OVER (ORDER BY chain) AS stretch FROM h),
    q AS (SELECT stretch, row_number() OVER (PARTITION BY stretch ORDER BY chain) AS i, {{'b': chain, 'f': f, 't': t, 'p': p}} AS v FROM k),
    s AS (SELECT DISTINCT stretch, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(b BIGINT, f BIGINT, t BIGINT, p BIGINT)[]) AS st, false AS fits FROM q
          UNION ALL
          SELECT stretch, i, st, len(st) > 1 AND st[-1].f - st[-2].t - 1 <= 16 AND 3 * (st[-1].p + st[-2].p) >= greatest(st[-1].t, st[-2].t) - st[-2].f + 1 AS fits
          FROM (SELECT s.stretch, CASE WHEN s.fits THEN s.i ELSE q.i END AS i,
                       CASE WHEN s.fits THEN list_append(s.st[1 : len(s.st) - 2], {{'b': s.st[-2].b, 'f': s.st[-2].f, 't': greatest(s.st[-1].t, s.st[-2].t), 'p': s.st[-1].p + s.st[-2].p}}) ELSE list_append(s.st, q.v) END AS st
                FROM s LEFT JOIN q ON q.stretch = s.stretch AND q.i = s.i + 1 WHERE s.fits OR q.i IS NOT NULL)),
    z AS (SELECT s.stretch, unnest(s.st) AS v FROM s JOIN (SELECT stretch, max(i) AS i FROM q GROUP BY stretch) m ON m.stretch = s.stretch AND m.i = s.i WHERE NOT s.fits)
    SELECT v.b AS block, v.f AS first, v.t AS covered, v.p AS placed FROM z""")
def joined_chains(spark, sf_dir):
    """All events as extents that lie apart, in chains that join where they are dense."""
    e = _table(spark, sf_dir, "events").selectExpr(*_SPARSE.split(", "))
    packed = 2 * F.col("count") >= F.col("last") - F.col("first") + 1
    e = e.withColumn("covered", F.when(packed, F.col("last")).otherwise(F.col("first"))).withColumn("placed", F.when(packed, F.col("count")).otherwise(1))
    return B.joined_chains(B.gone_chains(e))


@query("context_window", f"""WITH {_SQL_LINES}, t AS (SELECT line_no, event_type FROM l WHERE run_idx = 2), w AS (SELECT line_no FROM t WHERE event_type = 'purchase')
    SELECT w.line_no, string_agg(t.line_no || ':' || t.event_type, ' ' ORDER BY t.line_no) FILTER (WHERE t.line_no < w.line_no) AS before, string_agg(t.line_no || ':' || t.event_type, ' ' ORDER BY t.line_no) FILTER (WHERE t.line_no > w.line_no) AS after
    FROM w JOIN t ON t.line_no BETWEEN w.line_no - 2 AND w.line_no + 2 GROUP BY w.line_no""")
def context_window(spark, sf_dir):
    t = changed_lines(spark, sf_dir).where("run_idx = 2").select("line_no", F.substring_index(F.substring_index("raw", " ", 2), " ", -1).alias("raw"))
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["line_no"].cast("string"), F.lit(":"), x["raw"])), " ")
    return B.context(t, t.where("raw = 'purchase'"), 2).select("line_no", *[F.when(F.size(c) > 0, shown(c)).alias(c) for c in ("before", "after")])


# ---------------------------------------------------------------- fields

_STATUS = "CASE WHEN run_idx = 2 AND event_id % 1000 = 7 THEN 599 WHEN (run_idx = 2 AND event_type = 'view' AND event_id % 5 = 0) OR event_id % 50 = 0 THEN 503 ELSE 200 END"
_JSON = f"f AS (SELECT *, {_STATUS} AS status, CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 10 AS VARCHAR) AS k FROM (SELECT *, {_RUN} AS run_idx FROM events))"


def json_lines(spark, sf_dir):
    """A JSON object an event; every 200th line is plain text."""
    e = _table(spark, sf_dir, "events").withColumn("run_idx", F.expr(_RUN))
    k = (F.regexp_extract("props", "([0-9]+)", 1).cast("int") % 10).cast("string")
    obj = F.concat(F.lit('{"event":"'), "event_type", F.lit('","http":{"status":'), F.expr(_STATUS).cast("string"), F.lit('},"k":'), k, F.lit("}"))
    return e.select("run_idx", F.col("event_id").alias("line_no"), F.when(F.col("event_id") % 200 == 0, "plain text").otherwise(obj).alias("raw"))


def _watched(spark, sf_dir, pointer, by=()):
    seen = W.observed(json_lines(spark, sf_dir), (pointer,), by)
    cover, ledger = W.ledger(seen, 2, bool(by))
    return cover, ledger, W.completeness(cover, 2)


@query("field_coverage", f"WITH {_JSON} SELECT run_idx, count(*) AS lines, count(*) FILTER (WHERE event_id % 200 <> 0) AS matched, count(*) FILTER (WHERE event_id % 200 = 0) AS non_json FROM f GROUP BY run_idx")
def field_coverage(spark, sf_dir):
    return _watched(spark, sf_dir, "/k")[0].select("run_idx", "lines", "matched", "non_json")


_ODD = [  # (when, class, line): every class that coverage counts; oversized lines are built, as they are long
    ("event_id % 101 = 0", "non_json", "'plain text'"), ("event_id % 103 = 0", "invalid_json", """'{"k":1'"""), ("event_id % 107 = 0", "non_scalar", """'{"k":[1],"g":1}'"""),
    ("event_id % 109 = 0", "ambiguous", """'{"k":1,"k":2,"g":1}'"""), ("event_id % 113 = 0", "missing", """'{"g":1}'"""), ("event_id % 127 = 0", "group_missing", """'{"k":1}'"""),
    ("event_id % 131 = 0", "group_non_scalar", """'{"k":1,"g":{}}'"""), ("event_id % 137 = 0", "group_ambiguous", """'{"k":1,"g":1,"g":2}'"""),
    ("event_id % 4999 = 0", "oversized", """'{"k":1,"g":1,"pad":"' || repeat('x', 1048576) || '"}'"""),
]
_ODD_LINE = "CASE " + " ".join(f"WHEN {when} THEN {line}" for when, _, line in _ODD) + """ ELSE '{"k":' || CAST(event_id AS STRING) || ',"g":"' || event_type || '"}' END"""
_ODD_CLASS = "CASE " + " ".join(f"WHEN {when} THEN '{kind}'" for when, kind, _ in _ODD) + " ELSE 'matched' END"
_PROBLEM = "class NOT IN ('matched', 'missing', 'non_json')"


@query("field_coverage_classes", f"""WITH f AS (SELECT event_id, {_RUN} AS run_idx, {_ODD_LINE} AS raw, {_ODD_CLASS} AS class FROM events),
    t AS (SELECT *, class = 'matched' AND row_number() OVER (PARTITION BY class ORDER BY run_idx, event_id) > 256 AS untracked FROM f)
    SELECT run_idx, count(*) AS lines, {', '.join(f"count(*) FILTER (WHERE class = '{c}') AS {c}" for c in ['matched', *(k for _, k, _ in _ODD)])}, count(*) FILTER (WHERE untracked) AS untracked,
           min(event_id) FILTER (WHERE {_PROBLEM} OR untracked) AS problem_line, left(arg_min(raw, event_id) FILTER (WHERE {_PROBLEM} OR untracked), 4096) AS problem_raw,
           length(arg_min(raw, event_id) FILTER (WHERE {_PROBLEM} OR untracked)) > 4096 AS problem_truncated FROM t GROUP BY run_idx""".replace("STRING", "VARCHAR"))
def field_coverage_classes(spark, sf_dir):
    """Every counter of a grouped watch with many values, and where its first problem is."""
    lines = _table(spark, sf_dir, "events").select(F.expr(_RUN).alias("run_idx"), F.col("event_id").alias("line_no"), F.expr(_ODD_LINE).alias("raw"))
    cover, _ = W.ledger(durable(W.observed(lines, ("/k",), ("/g",))), 2, True, ("/k",))
    at = F.col("first_problem")
    return cover.select("run_idx", "lines", *W.CLASSES, at["line_no"].alias("problem_line"), at["raw"].alias("problem_raw"), at["truncated"].alias("problem_truncated"))


_PADDED = """'{"k":"' || CAST(event_id % 97 AS STRING) || '","pad":"' || repeat('界', CAST(event_id * 37 % 41 AS INTEGER) * 50) || '"}'"""
_CLIP = "CASE WHEN strlen(raw) > 4096 THEN left(raw, (4096 - strpos(raw, '界') + 1) // 3 + strpos(raw, '界') - 1) ELSE raw END"


@query("field_occurrences", f"""WITH f AS (SELECT event_id, {_RUN} AS run_idx, '"' || event_id % 97 || '"' AS value_json, {_PADDED} AS raw FROM events),
    o AS (SELECT *, row_number() OVER (PARTITION BY value_json, run_idx = 2 ORDER BY run_idx, event_id) AS nth, min(run_idx * 1000000000 + event_id) OVER (PARTITION BY value_json) AS seen FROM f),
    k AS (SELECT value_json FROM o GROUP BY value_json ORDER BY min(seen) LIMIT 64)
    SELECT value_json, run_idx = 2 AS in_target, CASE WHEN run_idx < 2 THEN run_idx END AS baseline_index, event_id AS line_no, {_CLIP} AS raw, strlen(raw) > 4096 AS truncated FROM o WHERE nth = 1 AND value_json IN (SELECT value_json FROM k)""".replace("STRING", "VARCHAR"))
def field_occurrences(spark, sf_dir):
    """Where each tracked value was first seen in the baselines and in the target, with its clipped line."""
    lines = _table(spark, sf_dir, "events").select(F.expr(_RUN).alias("run_idx"), F.col("event_id").alias("line_no"), F.expr(_PADDED).alias("raw"))
    values = durable(W.ledger(durable(W.observed(lines, ("/k",))), 2, False, ("/k",))[1])
    out = None
    for side in ("first_baseline", "first_target"):
        run = F.col(f"{side}.baseline_index") if side == "first_baseline" else F.lit(None).cast("int")
        own = values.where(F.col(side).isNotNull()).select("value_json", F.lit(side == "first_target").alias("in_target"), run.alias("baseline_index"), *(F.col(f"{side}.{c}").alias(c) for c in ("line_no", "raw", "truncated")))
        out = own if out is None else out.unionByName(own)
    return out


_PER_VALUE = "count(*) FILTER (WHERE run_idx = 0) AS c0, count(*) FILTER (WHERE run_idx = 1) AS c1, count(*) FILTER (WHERE run_idx = 2) AS tc"


@query("field_values", f"WITH {_JSON} SELECT k AS value_json, {_PER_VALUE} FROM f WHERE event_id % 200 <> 0 GROUP BY k")
def field_values(spark, sf_dir):
    return _watched(spark, sf_dir, "/k")[1].select("value_json", "c0", "c1", "tc")


_GROUPED = f"""{_JSON}, v AS (SELECT '"' || event_type || '"' AS group_value, CAST(status AS VARCHAR) AS value_json, {_PER_VALUE} FROM f WHERE event_id % 200 <> 0 GROUP BY ALL)"""


@query("field_values_grouped", f"WITH {_GROUPED} SELECT * FROM v")
def field_values_grouped(spark, sf_dir):
    return _watched(spark, sf_dir, "/http/status", ("/event",))[1].select(F.get("group_json", F.lit(0)).alias("group_value"), "value_json", "c0", "c1", "tc")


@query("field_novelty", f"WITH {_GROUPED} SELECT group_value, value_json, tc > 0 AND c0 + c1 = 0 AS is_new, max(c0 + c1) OVER (PARTITION BY group_value) > 0 AS group_seen_in_baseline FROM v")
def field_novelty(spark, sf_dir):
    cover, ledger, complete = _watched(spark, sf_dir, "/http/status", ("/event",))
    return W.field_values(ledger, complete, 2, True).select(F.get("group_json", F.lit(0)).alias("group_value"), "value_json", "is_new", "group_seen_in_baseline")


@query("field_rates", f"""WITH {_GROUPED}, g AS (SELECT *, sum(c0) OVER w AS t0, sum(c1) OVER w AS t1, sum(tc) OVER w AS tt FROM v WINDOW w AS (PARTITION BY group_value)),
    d AS (SELECT *, tc / CAST(tt AS DOUBLE) AS rate, least(c0 / CAST(t0 AS DOUBLE), c1 / CAST(t1 AS DOUBLE)) AS low, greatest(c0 / CAST(t0 AS DOUBLE), c1 / CAST(t1 AS DOUBLE)) AS high FROM g WHERE c0 + c1 > 0),
    x AS (SELECT *, CASE WHEN rate > high THEN rate - high WHEN rate < low THEN rate - low ELSE 0 END * 100 AS pp FROM d)
    SELECT group_value, value_json, round(rate, 6) AS target_rate, round(pp, 6) AS range_distance_pp, round({_SCORE}, 6) AS score FROM x WHERE pp <> 0 AND abs(pp) + 1e-12 >= 5 AND {_SCORE} >= {SIGNIFICANCE}""")
def field_rates(spark, sf_dir):
    _, ledger, complete = _watched(spark, sf_dir, "/http/status", ("/event",))
    groups = W.rate_groups(ledger, complete, 2)
    return W.rate_changes(ledger, groups, 2, 5.0, SIGNIFICANCE).select(
        F.get("group_json", F.lit(0)).alias("group_value"), "value_json", F.round("target_rate", 6).alias("target_rate"), F.round("range_distance_pp", 6).alias("range_distance_pp"), F.round("score", 6).alias("score")
    )


@query("order_status_rates", f"""WITH v AS (SELECT '"' || l_linestatus || '"' AS group_value, '"' || l_returnflag || '"' AS value_json, count(*) FILTER (WHERE year(l_shipdate) % 3 = 0) AS c0, count(*) FILTER (WHERE year(l_shipdate) % 3 = 1) AS c1, count(*) FILTER (WHERE year(l_shipdate) % 3 = 2) AS tc FROM lineitem GROUP BY ALL)
    SELECT group_value, value_json, c0, c1, tc FROM v""")
def order_status_rates(spark, sf_dir):
    item = _table(spark, sf_dir, "lineitem")
    raw = F.concat(F.lit('{"status":"'), "l_linestatus", F.lit('","flag":"'), "l_returnflag", F.lit('"}'))
    lines = item.select((F.year("l_shipdate") % 3).alias("run_idx"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"), raw.alias("raw"))
    _, ledger = W.ledger(W.observed(lines, ("/flag",), ("/status",)), 2, True)
    return ledger.select(F.get("group_json", F.lit(0)).alias("group_value"), "value_json", "c0", "c1", "tc")


# ---------------------------------------------------------------- novelty, numbering


@query("novel_lines", f"WITH {_SQL_LINES} SELECT line_no, event_type FROM l WHERE run_idx = 2 AND event_type NOT IN (SELECT event_type FROM l WHERE run_idx < 2)")
def novel_lines(spark, sf_dir):
    from driftlens.streaming.novel import model, novel

    lines = durable(changed_lines(spark, sf_dir))
    out = novel(lines.where("run_idx = 2"), model(lines.where("run_idx < 2")))
    return out.select("line_no", F.substring_index(F.substring_index("raw", " ", 2), " ", -1).alias("event_type"))


def _document_lines(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line"))


_DOC_LINES = "d AS (SELECT doc_id, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)"


@query("line_numbering", f"WITH {_DOC_LINES} SELECT doc_id, i, row_number() OVER (ORDER BY doc_id, i) AS line_no FROM d")
def line_numbering(spark, sf_dir):
    rows = _document_lines(spark, sf_dir).select(F.floor(F.col("doc_id") / 64).alias("_split"), F.struct("doc_id", "i").alias("_place"), F.struct("doc_id", F.col("i").cast("long").alias("i")).alias("raw"))
    return numbered(rows).select("raw.doc_id", "raw.i", "line_no")


_PLANTED = "(doc_id + i) % 4"


@query("decoding_loss", f"""WITH {_DOC_LINES}, n AS (SELECT *, row_number() OVER (ORDER BY doc_id, i) AS k FROM d)
    SELECT CAST(doc_id % 3 AS INTEGER) AS run_idx, count(*) AS lines, count(*) FILTER (WHERE {_PLANTED} > 0) AS lossy_lines, CAST(sum(CASE {_PLANTED} WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 5 END) AS BIGINT) AS lost,
           min(doc_id * 1000000 + i) FILTER (WHERE {_PLANTED} > 0) AS first_lossy FROM n GROUP BY doc_id % 3""")
def decoding_loss(spark, sf_dir):
    """Every line of every document with bytes planted that are no UTF-8: one alone, a character cut short, both and two alone; U+FFFD itself is no loss."""
    lines = _document_lines(spark, sf_dir)
    planted = F.when(F.expr(_PLANTED) == 1, F.unhex(F.lit("FF"))).when(F.expr(_PLANTED) == 2, F.unhex(F.lit("E282"))).when(F.expr(_PLANTED) == 3, F.unhex(F.lit("E28241FFC0EFBFBDFE"))).otherwise(F.unhex(F.lit("EFBFBD")))
    raw = F.concat(planted, F.encode(F.concat(F.lit(" "), F.col("line")), "utf-8")).cast("string")
    return losses(lines.select((F.col("doc_id") % 3).cast("int").alias("run_idx"), (F.col("doc_id") * 1000000 + F.col("i")).alias("line_no"), lost(raw).alias("loss")))


# ---------------------------------------------------------------- maskers

#: A text of each format that the documents lack; it stands before every line.
SAMPLES = {
    "iso_timestamp": "from 2031-07-09T18:06:51.204+02:00 to 2031-07-09 18:07:02,5 +",
    "named_timestamp": "[Wed Mar 19 21:40:08 2031] Fri, 7 Nov 2031 06:15:30 CET 28/Feb/2031:13:09:27 -0330",
    "syslog_timestamp": "Aug 21 07:58:33 after Nov  9 22:11:09",
    "slash_timestamp": "9/30/2031 05:44:12 until 30/9/2031 05:44:13.75",
    "epoch": "1930111222 1930111222333 3930111222",
    "clock": "ran 3:07:55.25 past 21:09:48",
    "uuid": "ref 7c0e81f2-05ad-4b6e-9d31-c8f24e6a90b7",
    "email": "from jo_k-2@mail.example.org",
    "ipv4": "192.0.2.77:5353 203.0.113.250 400.2.2.2",
    "ipv6": "[2001:db8::7]:993 2001:db8:1:2:3:4:5:6%en1",
    "temp_path": "/tmp/job-7/out.csv, /var/tmp/q_2/z",
    "hex_prefixed": "0x7FfeA0c9 0x",
    "hex_id": "c0ffee42 7654321 beefcafe9",
    "quantity": "36GiB 45 us 0.25h 7m3.5s 11h20m 54Mbps",
    "version": "2.40.1 8.6 9",
    "number": "4096 777 202020",
}

#: What stands before every line in ``masked`` and ``enveloped``, by column.
PROGRESS_SAMPLE = "....F [ 12%] "
ENVELOPES = {
    "cri": ("2031-07-09T18:06:51Z stderr F ", M.cri),
    "journald": ("Aug 21 07:58:33 node7 cron[4711]: ", M.journald),
    "timestamp": ("2031-07-09T18:06:51.7654321Z - ", M.strip_leading_timestamp),
}

# DuckDB's \b, \d and \s know ASCII alone.  Letters and numbers beyond it get an underscore on
# either side for the time of the masking, so that \b takes them for what they are (the micro
# sign, which is a unit, does not); \s is spelt out.
_SQL_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SQL_WIDE = r"[^\x00-\x7f\x{b5}\PL]|[^\x00-\x7f\PN]"
_HEX_RE2 = "|".join([rf"\b[0-9]{{{k}}}[a-fA-F][0-9a-fA-F]{{{6 - k},}}\b" for k in range(6)] + [r"\b[0-9]{6,}[a-fA-F][0-9a-fA-F]*\b"])


def _sql_masked(name: str, text: str) -> str:
    pattern, to = next((p, t) for n, p, t in P.SIMPLE if n == name)
    pattern = (_HEX_RE2 if name == "hex_id" else pattern).replace(r"\s", f"[{_SQL_SPACE}]").replace("'", "''")
    if name == "temp_path":  # no boundaries, and underscores are part of it
        return f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    if name == "email":  # underscores are part of it: neighbours are matched instead, each between two addresses standing twice
        twice = rf"regexp_replace({text}, '([^\pL\pN_.%+@-])', '\1' || chr(4) || '\1', 'g')"
        inner = pattern.removeprefix(r"\b[A-Za-z0-9._%+-]").removesuffix(r"\b")
        found = rf"(^|[^\pL\pN_])([A-Za-z0-9_][A-Za-z0-9._%+-]*{inner.removeprefix('+')})($|[^\pL\pN_])"
        return rf"regexp_replace(regexp_replace({twice}, '{found}', '\1{to}\3', 'g'), chr(4) || '.', '', 'gs')"
    marked = rf"regexp_replace({text}, '({_SQL_WIDE})', '_' || chr(2) || '\1' || chr(2) || '_', 'g')"
    return f"replace(replace(regexp_replace({marked}, '{pattern}', '{to}', 'g'), '_' || chr(2), ''), chr(2) || '_', '')"


_SQL_PROGRESS = rf"""array_to_string(list_transform(regexp_extract_all('{PROGRESS_SAMPLE}' || line, '[^{_SQL_SPACE}]+|[{_SQL_SPACE}]+'), lambda w:
    CASE WHEN regexp_full_match(w, '[.FEsSxX*URIfe]{{4,}}') AND length(w) - length(replace(w, '.', '')) >= 3 AND 2 * (length(w) - length(replace(w, '.', ''))) >= length(w)
         THEN CASE WHEN regexp_matches(w, '[FE]') THEN '<PROGRESS!>' ELSE '<PROGRESS>' END
         WHEN regexp_full_match(w, '[0-9%/\[\]()]+') THEN regexp_replace(w, '[0-9]+', '<NUM>', 'g') ELSE w END), '')"""
_SQL_PAYLOADS = {
    "cri": rf"SELECT doc_id, i, 'stderr' AS stream, regexp_replace(line, '^[{_SQL_SPACE}]+', '') AS payload FROM d",
    "journald": "SELECT doc_id, i, 'cron[<NUM>]' AS process, line AS payload FROM d",
    "timestamp": r"SELECT doc_id, i, regexp_replace(line, '^[ \t:-]+', '') AS payload FROM d",
}


def _by_line(lines: DataFrame, f, schema: str) -> DataFrame:
    """``f`` of every line, by the Python functions that mining applies."""
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def run(batches):
        for b in batches:
            made = list(zip(*map(f, b.column(2).to_pylist()), strict=True)) or [()] * len(names)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(c, pa.string()) for c in made)], ["doc_id", "i", *names])

    return lines.select("doc_id", F.col("i").cast("long").alias("i"), "line").mapInArrow(run, f"doc_id long, i long, {schema}")


def masked(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, i, line) with a column for each masker, whatever characters they hold."""
    columns = [M.MASKERS[n](F.concat(F.lit(sample + " "), "line")).alias(n) for n, sample in SAMPLES.items()]
    return lines.select("doc_id", F.col("i").cast("long").alias("i"), *columns, M.mask_progress(F.concat(F.lit(PROGRESS_SAMPLE), "line")).alias("progress"))


def enveloped(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, i, line) with what each envelope gives for them, whatever characters they hold."""
    c = {n: f(F.concat(F.lit(head), "line")) for n, (head, f) in ENVELOPES.items()}
    return lines.select(
        "doc_id", F.col("i").cast("long").alias("i"), c["cri"]["stream"].alias("stream"), c["cri"]["payload"].alias("cri"),
        c["journald"]["process"].alias("process"), c["journald"]["payload"].alias("journald"), c["timestamp"].alias("timestamp"),
    )


def _mask_queries(name: str, sample: str, sql: str) -> None:
    """``mask_X`` by the function that mining applies, ``mask_X_all`` by the Column function; every line of every document."""
    sql = f"WITH {_DOC_LINES} SELECT doc_id, i, {sql} AS masked FROM d"

    @query(f"mask_{name}", sql)
    def by_function(spark, sf_dir):
        return _by_line(_document_lines(spark, sf_dir), lambda line: (T.mask_one(name, sample + line),), "masked string")

    @query(f"mask_{name}_all", sql)
    def by_column(spark, sf_dir):
        return masked(_document_lines(spark, sf_dir)).select("doc_id", "i", F.col(name).alias("masked"))


def _envelope_queries(name: str, kept: str | None, sql: str) -> None:
    head = ENVELOPES[name][0]

    @query(f"envelope_{name}", f"WITH {_DOC_LINES} {sql}")
    def by_function(spark, sf_dir):
        def taken(line):
            words, payload = T.envelope(head + line)
            return (*words, payload)

        return _by_line(_document_lines(spark, sf_dir), taken, f"{kept} string, payload string" if kept else "payload string")

    @query(f"envelope_{name}_all", f"WITH {_DOC_LINES} {sql}")
    def by_column(spark, sf_dir):
        return enveloped(_document_lines(spark, sf_dir)).select("doc_id", "i", *([kept] if kept else []), F.col(name).alias("payload"))


for _n, _s in SAMPLES.items():
    _mask_queries(_n, _s + " ", _sql_masked(_n, f"('{_s} ' || line)"))
_mask_queries("progress", PROGRESS_SAMPLE, _SQL_PROGRESS)
for _n, _c in (("cri", "stream"), ("journald", "process"), ("timestamp", None)):
    _envelope_queries(_n, _c, _SQL_PAYLOADS[_n])


@query("mask_url", """WITH u AS (SELECT page_id, replace(url, '://', '://me:pw@') AS url FROM pages), s AS (SELECT page_id, split_part(url, '://', 1) AS scheme, substr(url, strpos(url, '://') + 3) AS rest FROM u),
    p AS (SELECT *, split_part(rest, '?', 1) AS before, strpos(rest, '?') AS q FROM s), h AS (SELECT *, split_part(before, '/', 1) AS host, string_split(before, '/')[2:] AS segments FROM p)
    SELECT page_id, 'see ' || scheme || '://<CRED>@' || split_part(host, '@', 2) || CASE WHEN len(segments) > 0 THEN '/' || array_to_string(list_transform(segments, lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') AND regexp_matches(x, '^1[0-9]{9}([0-9]{3})?$') THEN '<TS>' WHEN regexp_full_match(x, '[0-9]+') OR (regexp_full_match(x, '[0-9a-fA-F]{6,}') AND regexp_matches(x, '[a-fA-F]')) THEN '<ID>' ELSE x END), '/') ELSE '' END
           || CASE WHEN q > 0 AND q < length(rest) THEN '?<QUERY>' ELSE '' END || ' now' AS masked FROM h""")
def mask_url(spark, sf_dir):
    url = F.replace(F.col("url"), F.lit("://"), F.lit("://me:pw@"))
    return _table(spark, sf_dir, "pages").select("page_id", M.mask_urls(F.concat(F.lit("see "), url, F.lit(" now"))).alias("masked"))


# ---------------------------------------------------------------- whole comparisons, without SQL


_WORD = """CASE WHEN run_idx = 2 AND line_no BETWEEN 100 AND 111 THEN 'step' || chr(CAST(97 + line_no - 100 AS INTEGER)) WHEN run_idx = 2 AND line_no IN (150, 152, 154) THEN 'burst' || chr(CAST(97 + (line_no - 150) / 2 AS INTEGER))
    WHEN run_idx < 2 AND line_no BETWEEN 50 AND 57 THEN 'gone' || chr(CAST(97 + line_no - 50 AS INTEGER)) WHEN run_idx < 2 AND line_no BETWEEN 120 AND 123 THEN 'left' || chr(CAST(97 + line_no - 120 AS INTEGER)) ELSE event_type END"""
_SQL_BLOCKS = f"""
    e AS (SELECT *, {_RUN} AS run_idx FROM events), o AS (SELECT run_idx, event_type, row_number() OVER (PARTITION BY run_idx ORDER BY event_id) AS line_no FROM e), l AS (SELECT run_idx, line_no, {_WORD} AS w FROM o),
    kinds AS (SELECT w, count(*) FILTER (WHERE run_idx = 0) AS c0, count(*) FILTER (WHERE run_idx = 1) AS c1, count(*) FILTER (WHERE run_idx = 2) AS tc, min(run_idx * 1000000000000 + line_no) AS cid,
                     min(line_no) FILTER (WHERE run_idx = 2) AS target_line, min(line_no) FILTER (WHERE run_idx = 0) AS base_line FROM l GROUP BY w),
    totals AS (SELECT count(*) FILTER (WHERE run_idx = 0) AS t0, count(*) FILTER (WHERE run_idx = 1) AS t1, count(*) FILTER (WHERE run_idx = 2) AS tt FROM l),
    f AS (SELECT w, cid, c0, c1, tc, target_line, base_line, {_KIND} AS kind, {_SCORE} AS score, tc / CAST(tt AS DOUBLE) - (c0 + c1) / CAST(t0 + t1 AS DOUBLE) AS share FROM kinds, totals),
    g AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'new' THEN 0 WHEN 'gone' THEN 1 ELSE 2 END, score DESC, cid) - 1 AS INTEGER) AS index FROM f WHERE kind IS NOT NULL),
    n AS (SELECT l.line_no, l.w, l.line_no - lag(l.line_no) OVER (ORDER BY l.line_no) AS gap FROM l JOIN g ON g.w = l.w AND g.kind = 'new' WHERE l.run_idx = 2),
    r AS (SELECT line_no, w, max(CASE WHEN gap IS NULL OR gap > 3 THEN line_no END) OVER (ORDER BY line_no) AS run FROM n),
    s AS (SELECT run, min(line_no) AS first, max(line_no) AS last FROM r GROUP BY run HAVING count(DISTINCT w) >= 2),
    c AS (SELECT w, count(*) AS n, count(s.run) AS inside, arg_min(r.run, r.line_no) AS home FROM r LEFT JOIN s ON s.run = r.run GROUP BY w),
    nb AS (SELECT 'new' AS kind, s.first, s.last, c.w FROM c JOIN s ON s.run = c.home WHERE c.n = c.inside),
    x AS (SELECT w, cid, base_line AS line, base_line - lag(base_line) OVER (ORDER BY base_line) AS gap FROM g WHERE kind = 'gone'),
    y AS (SELECT *, count(*) FILTER (WHERE gap IS NULL OR gap > 3) OVER (ORDER BY line) AS chain FROM x),
    gb AS (SELECT 'gone' AS kind, min(line) OVER (PARTITION BY chain) AS first, max(line) OVER (PARTITION BY chain) AS last, w FROM y),
    m AS (SELECT b.kind, b.first, b.last, g.* EXCLUDE (kind) FROM (SELECT * FROM nb UNION ALL SELECT * FROM gb) b JOIN g ON g.w = b.w),
    b AS (SELECT kind, first, last, sum(CASE WHEN kind = 'gone' THEN c0 ELSE tc END) AS line_count, sum(score) AS score, count(*) AS n,
                 string_agg(CAST(index AS VARCHAR), ',' ORDER BY CASE WHEN kind = 'gone' THEN base_line ELSE target_line END) AS findings FROM m GROUP BY kind, first, last HAVING count(*) >= 2),
    z AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE kind WHEN 'new' THEN 0 ELSE 1 END, round(score, 6) DESC, first) - 1 AS INTEGER) AS block FROM b)
"""


def block_lines(spark, sf_dir):
    """A line an event; the target has two stretches of new lines, the baselines two of lines that it lacks."""
    e = _table(spark, sf_dir, "events").select(F.expr(_RUN).alias("run_idx"), F.col("event_type").alias("raw"), F.floor(F.col("event_id") / 65536).alias("_split"), F.col("event_id").alias("_place"))
    lines = numbered(e).withColumnRenamed("raw", "event_type")
    return lines.select("run_idx", "line_no", F.concat(F.expr(_WORD), F.lit(" happened")).alias("raw"))


def _block_report(spark, sf_dir):
    from driftlens.plans.diff import diff

    return diff(block_lines(spark, sf_dir), 2)


@query("diff_blocks", f"WITH {_SQL_BLOCKS} SELECT block, kind, first AS first_line_no, last AS last_line_no, CAST(line_count AS BIGINT) AS line_count, CAST(0 AS BIGINT) AS lines_elsewhere, round(score, 6) AS score, findings FROM z")
def diff_blocks(spark, sf_dir):
    b = _block_report(spark, sf_dir).blocks
    return b.select("block", "kind", "first_line_no", "last_line_no", "line_count", "lines_elsewhere", F.round("score", 6).alias("score"), F.array_join(F.col("findings").cast("array<string>"), ",").alias("findings"))


@query("findings_page", f"""WITH {_SQL_BLOCKS} SELECT index, kind, w || ' happened' AS template, round(score, 6) AS score FROM g WHERE contains(lower(w || ' happened'), 'e') ORDER BY index LIMIT 7 OFFSET 7""")
def findings_page(spark, sf_dir):
    """The second page of seven findings whose text has an E, begun behind the last row of the first."""
    found = durable(_block_report(spark, sf_dir).findings)
    first = pages.findings_page(found, query=" E ", size=7)
    second = pages.findings_page(found, query=" E ", after=first.tail(1)[0], size=7)
    return second.select("index", "kind", "template", F.round("score", 6).alias("score"))


@query("diff_report", f"""WITH {_SQL_BLOCKS} SELECT g.index, g.kind, CASE WHEN g.kind = 'new' THEN 'up' WHEN g.kind = 'gone' THEN 'down' WHEN g.share > 0 THEN 'up' ELSE 'down' END AS direction, g.w || ' happened' AS template, round(g.score, 6) AS score,
    g.tc AS target_count, z.block FROM g LEFT JOIN m ON m.w = g.w LEFT JOIN z ON z.kind = m.kind AND z.first = m.first""")
def diff_report(spark, sf_dir):
    """All findings in their order, with their blocks."""
    return _block_report(spark, sf_dir).findings.select("index", "kind", "direction", "template", F.round("score", 6).alias("score"), "target_count", "block")


def _block_findings(spark, sf_dir):
    """(mined lines, counts, findings) of ``block_lines``."""
    lines = durable(block_lines(spark, sf_dir))
    mined = mine(lines)
    counts = durable(C.counted(mined, 2))
    return lines, mined, counts, C.findings(counts, C.run_totals(mined, 3), 2, SIGNIFICANCE)


def _mined_runs(spark, sf_dir):
    """The runs that the lines of new templates of the target make."""
    _, mined, counts, _ = _block_findings(spark, sf_dir)
    return B.new_runs(mined.assigned.where("run_idx = 2").join(counts.where("first_any IS NULL").select("cid"), "cid").select("line_no", "cid"))


@query("new_runs_all", f"WITH {_SQL_BLOCKS} SELECT line_no, run FROM r")
def new_runs_all(spark, sf_dir):
    """Runs of new lines as they are mined, of a target with two bursts."""
    return _mined_runs(spark, sf_dir).select("line_no", "run")


@query("new_blocks_all", f"WITH {_SQL_BLOCKS} SELECT first, last, count(*) AS members FROM nb GROUP BY first, last HAVING count(*) >= 2")
def new_blocks_all(spark, sf_dir):
    return B.new_blocks(durable(_mined_runs(spark, sf_dir))).select("first", "last", F.size("members").cast("long").alias("members"))


@query("gone_chains_all", f"WITH {_SQL_BLOCKS} SELECT line AS first, w || ' happened' AS template, chain FROM y")
def gone_chains_all(spark, sf_dir):
    """Chains of the templates that the target lacks, as they are mined."""
    _, _, counts, found = _block_findings(spark, sf_dir)
    return B.gone_chains(B.gone_extents(found)).join(counts.select("cid", "template"), "cid").select("first", "template", "chain")


@query("context_window_all", f"""WITH {_SQL_BLOCKS}, t AS (SELECT line_no, w FROM l WHERE run_idx = 2), q AS (SELECT target_line AS line_no FROM g WHERE target_line IS NOT NULL)
    SELECT q.line_no, string_agg(t.w, ' ' ORDER BY t.line_no) FILTER (WHERE t.line_no < q.line_no) AS before, string_agg(t.w, ' ' ORDER BY t.line_no) FILTER (WHERE t.line_no > q.line_no) AS after
    FROM q JOIN t ON t.line_no BETWEEN q.line_no - 3 AND q.line_no + 3 GROUP BY q.line_no""")
def context_window_all(spark, sf_dir):
    """Three lines on either side of where each finding was first met in the target."""
    lines, _, _, found = _block_findings(spark, sf_dir)
    shown = lambda c: F.array_join(F.transform(c, lambda x: F.substring_index(x["raw"], " ", 1)), " ")
    wanted = durable(found.where("first_target_line_no IS NOT NULL").select(F.col("first_target_line_no").alias("line_no")))
    return B.context(lines.where("run_idx = 2"), wanted, 3).select("line_no", *[F.when(F.size(c) > 0, shown(c)).alias(c) for c in ("before", "after")])
