"""Registered queries on whole runs: grids of rules, pairs, provenance, guards between runs, athletes, undeclared exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cols as c
from ..operators import landmarks as L
from ..operators import quantities as Q
from ..operators import sweeps
from ..sources import files
from ..sources.trials import SAMPLES_CTE, trials
from . import provenance as P
from .cohort_queries import RANKED_SQL, ranked
from .trial_queries import BASE, RESULTS_SQL, placed, results_frame, rounded

G = L.GRAVITY
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


#: Axes of the registered sweep, in table order; the cap leaves out the last two of its twelve combinations.
AXES = {"k": [3, 5, 8], "back": [0, 3], "span": [3, 5]}
GRID_CAP = 10

GRID_SQL = (
    BASE
    + f""", vr AS (SELECT v, ks[1 + v % 3] AS kk, bs[1 + (v // 3) % 2] AS bb, ss[1 + (v // 6) % 2] AS span FROM range(12) AS r(v), (SELECT [3, 5, 8] AS ks, [0, 3] AS bs, [3, 5] AS ss) WHERE v < {GRID_CAP}),
o5 AS (SELECT s.trial_id, idx, max(f) OVER x AS hi, count(*) OVER x AS c, w, sd, takeoff, 5 AS span FROM s JOIN ep USING (trial_id) LEFT JOIN tk USING (trial_id) WINDOW x AS (PARTITION BY s.trial_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
ob AS (SELECT trial_id, idx, hi, c, w, sd, takeoff, 3 AS span FROM oq UNION ALL SELECT trial_id, idx, hi, c, w, sd, takeoff, span FROM o5),
on2 AS (SELECT trial_id, kk, span, min(idx) AS o FROM ob JOIN (SELECT DISTINCT kk, span FROM vr) USING (span) WHERE idx >= 100 AND idx < takeoff AND c = span AND sd > 0 AND w - kk * sd > 0 AND hi < w - kk * sd GROUP BY ALL),
gv AS (SELECT lm.trial_id, lm.subject, v, 'k=' || kk || ',back=' || bb || ',span=' || span AS rule, lm.takeoff, lm.w, CASE WHEN o IS NOT NULL THEN greatest(o - bb, 0) END AS o FROM lm CROSS JOIN vr LEFT JOIN on2 USING (trial_id, kk, span)),
cs AS (SELECT trial_id, idx, f, sum(f) OVER (PARTITION BY trial_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cf FROM s),
hv AS (SELECT gv.trial_id, gv.subject, v::INT AS variant, rule, CASE WHEN o < takeoff THEN ((b.cf - a.cf + a.f - 0.5e0 * (a.f + b.f) - (takeoff - 1 - o) * w) * 0.01e0 / (w / {G})) ** 2 / (2 * {G}) END AS value
  FROM gv LEFT JOIN cs a ON a.trial_id = gv.trial_id AND a.idx = o LEFT JOIN cs b ON b.trial_id = gv.trial_id AND b.idx = takeoff - 1)
"""
)


def swept(d: DataFrame, axes: dict, cap: int) -> DataFrame:
    """Jump height of placed trials under every variant of a grid, an array in the trial's row: (variant, rule, value).

    Axes are k, back and span of the noise rule. Onset is placed once for each (k, span); weighing and takeoff stay.
    """
    variants, capped = sweeps.grid(axes, cap)
    places = {(v["k"], v["span"]): f"_o{v['k']}_{v['span']}" for v in variants}
    for (k, span), name in places.items():
        d = d.withColumn(name, L.onset_noise(c.force, c.weight, F.col("weight_sd"), float(k), span, 0, F.col("epoch_end"), c.takeoff))
    starts = {(v["k"], v["span"], v["back"]): f"_h{v['k']}_{v['span']}_{v['back']}" for v in variants}
    for (k, span, back), name in starts.items():
        start = F.greatest(F.col(places[k, span]) - back, F.lit(0))
        velocity = Q.impulse(c.force, F.when(F.col(places[k, span]).isNotNull() & (start < c.takeoff), start), c.last, c.weight) / (c.weight / G)
        d = d.withColumn(name, F.pow(velocity, F.lit(2)) / (2 * G))
    rows = [F.struct(F.lit(i).alias("variant"), F.lit(sweeps.label(v)).alias("rule"), F.col(starts[v["k"], v["span"], v["back"]]).alias("value")) for i, v in enumerate(variants)]
    return d.select("trial_id", "subject", F.array(*rows).alias("variants"), F.lit(capped).alias("capped"))


@query("sweep_grid", GRID_SQL + "SELECT trial_id, variant, rule, round(value, 6) AS value, true AS capped FROM hv")
def sweep_grid(spark, sf_dir):
    """Every trial under a capped grid of rules: mixed radix in table order, the first axis fastest."""
    d = swept(placed(spark, sf_dir), AXES, GRID_CAP).select("trial_id", F.inline("variants"), "capped")
    return d.select("trial_id", "variant", "rule", F.round("value", 6).alias("value"), "capped")


@query(
    "compare_pairs",
    GRID_SQL.replace(f"WHERE v < {GRID_CAP}", "WHERE v < 12")
    + """, nn AS (SELECT trial_id, list({'rule': rule, 'value': value} ORDER BY variant) FILTER (value IS NOT NULL) AS held, count(value) AS answered FROM hv GROUP BY trial_id)
SELECT trial_id, held[1].rule AS first_rule, round(held[1].value, 6) AS first_value, held[2].rule AS second_rule, round(held[2].value, 6) AS second_value, answered = 12 AS complete FROM nn WHERE answered >= 2""",
)
def compare_pairs(spark, sf_dir):
    """The first two answers of each trial in table order, and whether every variant gave one. Nothing is shuffled."""
    d = swept(placed(spark, sf_dir), AXES, sweeps.CAP).withColumn("held", F.filter("variants", lambda x: x["value"].isNotNull()))
    one = lambda i, f: F.get("held", F.lit(i))[f]
    return d.where(F.size("held") >= 2).select(
        "trial_id",
        one(0, "rule").alias("first_rule"),
        F.round(one(0, "value"), 6).alias("first_value"),
        one(1, "rule").alias("second_rule"),
        F.round(one(1, "value"), 6).alias("second_value"),
        (F.size("held") == F.size("variants")).alias("complete"),
    )


def with_provenance(d: DataFrame) -> tuple[DataFrame, dict[str, dict]]:
    """Placed trials with the id of the chain that ran for each, and the chains by id."""
    answered = {"onset": c.onset.isNotNull(), "takeoff": c.takeoff.isNotNull(), "touchdown": c.touchdown.isNotNull()}
    chain, chains = P.variants_by(answered)
    return d.withColumn("provenance_id", chain), chains


def _chain_sql() -> str:
    """SQL of a trial's canonical chain, from the same table of rules."""
    parts = []
    for depth, (slot, (rule, parameters)) in enumerate(P.DEFAULT.items()):
        told = [f"{depth}|{slot}|{rule}|{k}|{v}" for k, v in sorted(parameters.items())]
        text = "[" + ", ".join(f"'{x}'" for x in told) + "]"
        parts.append(text if slot == "weighing" else f"CASE WHEN {slot} IS NULL THEN ['{depth}|{slot}|declined||'] ELSE {text} END")
    return "array_to_string(list_sort(flatten([" + ", ".join(parts) + "])), ';')"


CHAIN_SQL = BASE + f", ch AS (SELECT *, {_chain_sql()} AS chain FROM lm), cid AS (SELECT *, substr(sha256(chain), 1, 16) AS provenance_id FROM ch)"


@query(
    "provenance_parameters",
    CHAIN_SQL
    + """, pl AS (SELECT provenance_id, count(*) AS trials, unnest(string_split(any_value(chain), ';')) AS line FROM cid GROUP BY provenance_id)
SELECT provenance_id, split_part(line, '|', 1)::INT AS depth, split_part(line, '|', 2) AS slot, split_part(line, '|', 3) AS rule, split_part(line, '|', 4) AS parameter, split_part(line, '|', 5) AS value, trials FROM pl""",
)
def provenance_parameters(spark, sf_dir):
    """Rules and parameters of every chain that ran, a row each, with how many trials went by it."""
    d, chains = with_provenance(placed(spark, sf_dir))
    rows = [(i, *line) for i, chain in chains.items() for line in P.lines(chain)]
    table = spark.createDataFrame(rows, "provenance_id string, depth int, slot string, rule string, parameter string, value string")
    return F.broadcast(table).join(d.groupBy("provenance_id").agg(F.count("*").alias("trials")), "provenance_id")


@query(
    "results_with_provenance",
    CHAIN_SQL + " SELECT trial_id, provenance_id, CASE WHEN onset IS NULL THEN 'declined' ELSE 'noise_relative' END AS onset_rule, CASE WHEN onset IS NULL THEN NULL ELSE '5.0' END AS onset_k FROM cid",
)
def results_with_provenance(spark, sf_dir):
    """Results joined to the rules that made them: the table of chains is as long as there are chains."""
    d, chains = with_provenance(placed(spark, sf_dir))
    rows = [(i, x["onset"][0], x["onset"][1].get("k")) for i, x in chains.items()]
    table = spark.createDataFrame(rows, "provenance_id string, onset_rule string, onset_k string")
    return d.select("trial_id", "provenance_id").join(F.broadcast(table), "provenance_id")


@query(
    "run_fingerprint",
    CHAIN_SQL
    + """, ru AS (SELECT count(*) AS trials, count(*) FILTER (onset < takeoff) AS computed, string_agg(DISTINCT provenance_id, ',' ORDER BY provenance_id) AS ids FROM cid)
SELECT trials, computed, true AS complete, sha256('trials=' || trials || ';computed=' || computed || ';' || ids) AS fingerprint FROM ru""",
)
def run_fingerprint(spark, sf_dir):
    """Digest of a run's counts and of the set of its chains; published only where no count is missing."""
    d, _ = with_provenance(placed(spark, sf_dir))
    run = d.agg(F.count("*").alias("trials"), F.count(F.when(c.ordered, 1)).alias("computed"), F.array_join(F.array_sort(F.collect_set("provenance_id")), ",").alias("ids"))
    complete = F.col("trials").isNotNull() & F.col("computed").isNotNull() & (F.col("ids") != "")
    text = F.concat(F.lit("trials="), "trials", F.lit(";computed="), "computed", F.lit(";"), "ids")
    return run.select("trials", "computed", complete.alias("complete"), F.when(complete, F.sha2(text, 256)).alias("fingerprint"))


NAME = "CASE WHEN trial_id % 13 = 0 THEN 'notes_' || trial_id || '.csv' WHEN trial_id % 17 = 0 THEN 'AT_' || trial_id || '.force.txt' ELSE 'AT' || subject || '_' || trial_id || '.force.txt' END"


@query(
    "run_refusals",
    BASE
    + f""", nm AS (SELECT trial_id, {NAME} AS name, takeoff, onset, touchdown, sd FROM lm),
st AS (SELECT *, CASE WHEN NOT suffix(name, '.force.txt') THEN 'without_suffix' WHEN trial_id % 17 = 0 THEN 'unidentified' END AS identity, rtrim(CASE WHEN suffix(name, '.force.txt') THEN substr(name, 1, length(name) - 10) END, '.') AS stem FROM nm)
SELECT name, stem, identity AS code FROM st WHERE identity IS NOT NULL
UNION ALL SELECT name, stem, 'no_takeoff' FROM st WHERE identity IS NULL AND takeoff IS NULL
UNION ALL SELECT name, stem, 'collapsed_band' FROM st WHERE identity IS NULL AND sd <= 0
UNION ALL SELECT name, stem, 'no_touchdown' FROM st WHERE identity IS NULL AND touchdown IS NULL""",
)
def run_refusals(spark, sf_dir):
    """Files without an identity and trials with a blank in one relation: no file is lost."""
    d = placed(spark, sf_dir).withColumn("name", F.expr(NAME))
    d = files.identify(d.drop("subject"), "name", "AT{subject}_{trial}", ".force.txt").withColumn("stem", files.stem(F.col("name"), ".force.txt"))
    unknown = d.where("status <> 'ok'").select("name", "stem", F.col("status").alias("code"))
    codes = F.array_compact(F.array(F.when(c.takeoff.isNull(), "no_takeoff"), F.when(F.col("weight_sd") <= 0, "collapsed_band"), F.when(c.touchdown.isNull(), "no_touchdown")))
    return unknown.unionByName(d.where("status = 'ok'").select("name", "stem", F.explode(codes).alias("code")))


@query(
    "same_repetition",
    RESULTS_SQL
    + """, a AS (SELECT trial_id, height_takeoff AS x FROM q WHERE height_takeoff IS NOT NULL), b AS (SELECT trial_id, height_flight AS y FROM q WHERE height_flight IS NOT NULL)
SELECT trial_id, CASE WHEN y IS NULL THEN 'only_first' ELSE 'only_second' END AS mismatch FROM a FULL JOIN b USING (trial_id) WHERE x IS NULL OR y IS NULL""",
)
def same_repetition(spark, sf_dir):
    """Trials that one list of values holds and the other does not: such lists may not be paired."""
    d = results_frame(spark, sf_dir).select("trial_id", "height_takeoff", "height_flight")
    a = d.where("height_takeoff IS NOT NULL").select("trial_id", F.col("height_takeoff").alias("x"))
    b = d.where("height_flight IS NOT NULL").select("trial_id", F.col("height_flight").alias("y"))
    e = a.join(b, "trial_id", "full_outer").where("x IS NULL OR y IS NULL")
    return e.select("trial_id", F.when(F.col("y").isNull(), "only_first").otherwise("only_second").alias("mismatch"))


@query(
    "subject_values",
    RANKED_SQL + "SELECT subject, occasion, count(*) AS trials, array_to_string(list(round(value, 4)::VARCHAR ORDER BY trial_id), ' ') AS values FROM ra GROUP BY ALL",
)
def subject_values(spark, sf_dir):
    """The values of each session's trials in order of trial, one list for a session."""
    d = ranked(spark, sf_dir).groupBy("subject", "occasion")
    d = d.agg(F.count("*").alias("trials"), F.sort_array(F.collect_list(F.struct("trial_id", F.round("value", 4).cast("string").alias("v")))).alias("a"))
    return d.select("subject", "occasion", "trials", F.array_join(F.transform("a", lambda x: x["v"]), " ").alias("values"))


@query(
    "reliability_cv_difference",
    RANKED_SQL
    + """, p AS (SELECT subject, stddev_samp(value) AS s, avg(value) AS m, stddev_samp(rank) AS sr, avg(rank) AS mr FROM ra GROUP BY subject HAVING count(value) >= 2)
SELECT round(avg(100 * s / m), 6) AS first_cv, round(avg(100 * sr / mr), 6) AS second_cv, round(avg(100 * s / m) - avg(100 * sr / mr), 6) AS difference FROM p""",
)
def reliability_cv_difference(spark, sf_dir):
    """Difference of two coefficients of variation, which only one convention of dispersion allows."""
    d = ranked(spark, sf_dir)
    per = d.groupBy("subject").agg(*[f(x).alias(f"{n}_{x}") for x in ("value", "rank") for n, f in (("s", F.stddev_samp), ("m", F.avg))], F.count("value").alias("k"))
    cv = lambda x, dispersion: (F.avg(100 * F.col(f"s_{x}") / F.col(f"m_{x}")), dispersion)
    (a, first), (b, second) = cv("value", "sample"), cv("rank", "sample")
    return per.where("k >= 2").agg(*rounded(first_cv=a, second_cv=b, difference=a - b if first == second else F.lit(None)))


@query(
    "ranking_column",
    "SELECT construct, count(*) AS candidates, CASE WHEN count(*) = 1 THEN max(quantity) END AS resolved, CASE WHEN count(*) = 1 THEN 'ok' ELSE 'ambiguous' END AS status, (SELECT count(*) FROM orders) AS trials FROM (VALUES ('peak_force', 'peak_gross'), ('jump_height', 'height_takeoff'), ('jump_height', 'height_flight'), ('net_impulse', 'net_impulse')) AS t(construct, quantity) GROUP BY construct",
)
def ranking_column(spark, sf_dir):
    """The result column that fills a named construct: none, or more than one, is refused."""
    made = {"peak_gross": "peak_force", "height_takeoff": "jump_height", "height_flight": "jump_height", "net_impulse": "net_impulse"}
    d = results_frame(spark, sf_dir).withColumn("peak_gross", F.array_max("force"))
    rows = F.array(*[F.struct(F.lit(v).alias("construct"), F.lit(k).alias("quantity")) for k, v in made.items() if k in d.columns])
    d = d.select("trial_id", F.inline(rows)).groupBy("construct", "quantity").agg(F.count("*").alias("trials"))
    d = d.groupBy("construct").agg(F.count("*").alias("candidates"), F.max("quantity").alias("q"), F.max("trials").alias("trials"))
    one = F.col("candidates") == 1
    return d.select("construct", "candidates", F.when(one, F.col("q")).alias("resolved"), F.when(one, "ok").otherwise("ambiguous").alias("status"), "trials")


@query(
    "marker_effect",
    RESULTS_SQL
    + """, x AS (SELECT coalesce(height_takeoff, 0) AS a, coalesce(rsi_modified, 0) AS b FROM q)
SELECT count(*) AS filed, count(*) FILTER (a <> 0 AND b <> 0) AS measured, round(corr(a, b), 6) AS as_filed, round(corr(a, b) FILTER (a <> 0 AND b <> 0), 6) AS without_markers FROM x""",
)
def marker_effect(spark, sf_dir):
    """A correlation with blanks filed as zero, and with those rows left out."""
    a, b = F.coalesce("height_takeoff", F.lit(0.0)), F.coalesce("rsi_modified", F.lit(0.0))
    d = results_frame(spark, sf_dir).select(a.alias("a"), b.alias("b"))
    held = (F.col("a") != 0) & (F.col("b") != 0)
    x, y = (F.when(held, F.col(n)) for n in ("a", "b"))
    return d.agg(F.count("*").alias("filed"), F.count(F.when(held, 1)).alias("measured"), F.round(F.corr("a", "b"), 6).alias("as_filed"), F.round(F.corr(x, y), 6).alias("without_markers"))


@query(
    "missing_samples",
    f"""WITH {SAMPLES_CTE}, z AS (SELECT trial_id, idx, CASE WHEN trial_id % 31 = 0 AND idx % 50 = 7 THEN 'nan'::DOUBLE ELSE f END AS f FROM s)
SELECT trial_id, count(*) FILTER (isnan(f)) AS not_finite, CASE WHEN count(*) FILTER (isnan(f)) > 0 THEN 0 ELSE count(*) FILTER (f = 0) END AS marked, count(*) FILTER (f <> 0 AND NOT isnan(f)) AS kept,
  coalesce(min(idx) FILTER (f = 0 OR isnan(f)), -1)::INT AS first_dropped, coalesce(max(idx) FILTER (f = 0 OR isnan(f)), -1)::INT AS last_dropped, count(*) FILTER (isnan(f) AND idx < 100) = 0 AS weighing_whole FROM z GROUP BY trial_id""",
)
def missing_samples(spark, sf_dir):
    """Samples that are no number, or else the declared marker (0); what partitioning them out keeps and drops; the span guard."""
    force = F.transform("force", lambda x, i: F.when((F.col("trial_id") % 31 == 0) & (i % 50 == 7), float("nan")).otherwise(x))
    d = A.settled(trials(spark, sf_dir).select("trial_id", "force"), force=force)
    d = files.missing_report(d, "force", 0.0)
    return d.select("trial_id", "not_finite", "marked", "kept", "first_dropped", "last_dropped", (~A.has_bad(A.between(c.force, 0, 100))).alias("weighing_whole"))


MARKS = "CASE WHEN trial_id % 3 = 0 THEN ',' WHEN trial_id % 3 = 1 THEN ';' ELSE chr(9) END"


@query(
    "undeclared_export",
    f"""WITH {SAMPLES_CTE}, n AS (SELECT trial_id, count(*) AS n, sum(f) AS total FROM s GROUP BY trial_id)
SELECT trial_id, CASE WHEN trial_id % 3 = 0 THEN 'comma' WHEN trial_id % 3 = 1 THEN 'semicolon' ELSE 'tab' END AS delimiter, (CASE WHEN trial_id % 4 = 0 THEN 1 ELSE 3 END)::INT AS skipped_lines, trial_id % 4 <> 0 AS header_detected, 3::INT AS column_count,
  n::INT AS row_count, (CASE WHEN trial_id % 50 = 0 THEN 1 ELSE 0 END)::INT AS ragged_rows, CASE WHEN trial_id % 7 <> 0 THEN 0 END::INT AS time_column, 1::INT AS force_column, 1::INT AS force_like,
  CASE WHEN trial_id % 7 <> 0 THEN 100e0 END AS rate_hz, CASE WHEN trial_id % 7 <> 0 THEN 'even' ELSE 'uneven' END AS rate_source, round(total, 3) AS force_total FROM n""",
)
def undeclared_export(spark, sf_dir):
    """Exports whose delimiter, preamble, header, columns and sample rate nobody declared, read whole."""
    mark = F.expr(MARKS)
    stamp = lambda i: (i / 100 + F.when(F.col("trial_id") % 7 == 0, 0.05 * F.floor(i / 9)).otherwise(0.0)).cast("decimal(12,2)").cast("string")
    line = lambda x, i: F.concat(stamp(i), mark, x.cast("string"), mark, F.lit("1.5"))
    head = F.when(F.col("trial_id") % 4 == 0, F.lit("made by hand\n")).otherwise(F.concat(F.lit("plate export\nunit N\n"), F.lit("time"), mark, F.lit("Fz"), mark, F.lit("aux\n")))
    d = trials(spark, sf_dir).select("trial_id", "force")
    ragged = F.when(F.col("trial_id") % 50 == 0, F.lit("\n7\n")).otherwise("\n")
    d = d.select("trial_id", F.concat(head, F.array_join(F.transform("force", line), "\n"), ragged).alias("text"))
    d = d.withColumn("x", files.undeclared(F.col("text")))
    shown = ["delimiter", "skipped_lines", "header_detected", "column_count", "row_count", "ragged_rows", "time_column", "force_column", "force_like", "rate_hz", "rate_source"]
    return d.select("trial_id", *[F.col(f"x.{n}").alias(n) for n in shown], F.round("x.force_total", 3).alias("force_total"))
