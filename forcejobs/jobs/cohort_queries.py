"""Registered queries on phases, validity, relations, sweeps, athletes and agreement, each with the SQL of the same answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cols as c
from ..functions import scans
from ..functions import traces as T
from ..operators import cohort as C
from ..operators import landmarks as L
from ..operators import phases as P
from ..operators import quantities as Q
from ..sources import store
from .trial_queries import BASE, RESULTS_SQL, answerable, moving, needs, placed, results_frame, rounded, sql_rounded, whole, whole_sql

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


@query(
    "phase_boundaries",
    BASE
    + """, j AS (SELECT * FROM k WHERE onset < takeoff),
ex AS (SELECT trial_id, any_value(w) AS w, any_value(onset) AS onset, any_value(takeoff) AS takeoff, any_value(n) AS n, min(v) FILTER (idx BETWEEN onset AND takeoff - 1) AS lv, max(v) FILTER (idx BETWEEN onset AND takeoff - 1) AS hv,
   max(f) FILTER (idx BETWEEN onset AND takeoff - 1) AS hf FROM j GROUP BY trial_id),
ix AS (SELECT trial_id, min(idx) FILTER (v = lv) AS vmin, min(idx) FILTER (v = hv) AS vmax, min(idx) FILTER (f = hf) AS fmax FROM j JOIN ex USING (trial_id) WHERE idx BETWEEN j.onset AND j.takeoff - 1 GROUP BY trial_id),
lf AS (SELECT trial_id, min(f) AS lf FROM j JOIN ix USING (trial_id) WHERE idx >= onset AND idx < fmax GROUP BY trial_id),
fm AS (SELECT trial_id, min(idx) AS fmin FROM j JOIN ix USING (trial_id) JOIN lf USING (trial_id) WHERE idx >= onset AND idx < fmax AND f = lf GROUP BY trial_id),
ri AS (SELECT trial_id, max(idx) AS r FROM j JOIN fm USING (trial_id) JOIN ix USING (trial_id) WHERE idx BETWEEN fmin AND fmax AND f <= w GROUP BY trial_id),
fa AS (SELECT trial_id, min(idx) AS fall FROM j JOIN ix USING (trial_id) WHERE idx BETWEEN fmax AND takeoff AND f <= w GROUP BY trial_id),
nx AS (SELECT *, lead(v) OVER (PARTITION BY trial_id ORDER BY idx) AS nv FROM j),
vc AS (SELECT trial_id, min(idx) FILTER (v <= 0 AND nv > 0) + 1 AS zero_v, min(idx) FILTER (v <= 0.01e0 AND nv > 0.01e0) + 1 AS slow_v FROM nx JOIN ix USING (trial_id) WHERE idx >= vmin AND idx < takeoff - 1 GROUP BY trial_id)
SELECT trial_id, vmin AS braking_start_velocity, CASE WHEN r < fmax THEN r END AS braking_start_force, fmin AS braking_start_min_force, zero_v AS propulsion_start_zero, slow_v AS propulsion_start_threshold, fmax AS propulsion_start_peak,
  vmax AS propulsion_end_velocity, CASE WHEN fall > fmax THEN fall END AS propulsion_end_force, zero_v + (takeoff - zero_v) // 2 AS propulsion_middle
FROM ex JOIN ix USING (trial_id) LEFT JOIN fm USING (trial_id) LEFT JOIN ri USING (trial_id) LEFT JOIN fa USING (trial_id) LEFT JOIN vc USING (trial_id)""",
)
@whole
def phase_boundaries(spark, sf_dir):
    """Starts and ends of braking and propulsion by each rule."""
    v = F.col("velocity")
    d = moving(spark, sf_dir).transform(answerable)
    d = d.withColumns({"top": A.argmax(c.force, c.onset, c.takeoff), "zero": P.velocity_crossing(v, c.onset, c.takeoff), "slow": P.velocity_crossing(v, c.onset, c.takeoff, 0.01)})
    return d.select(
        "trial_id",
        "code",
        A.argmin(v, c.onset, c.takeoff).alias("braking_start_velocity"),
        P.rising_crossing(c.force, c.weight, c.onset, F.col("top")).alias("braking_start_force"),
        A.argmin(c.force, c.onset, F.col("top")).alias("braking_start_min_force"),
        F.col("zero").alias("propulsion_start_zero"),
        F.col("slow").alias("propulsion_start_threshold"),
        F.col("top").alias("propulsion_start_peak"),
        A.argmax(v, c.onset, c.takeoff).alias("propulsion_end_velocity"),
        P.falling_crossing(c.force, c.weight, F.col("top"), c.takeoff).alias("propulsion_end_force"),
        (F.col("zero") + F.floor((c.takeoff - F.col("zero")) / 2).cast("int")).alias("propulsion_middle"),
    )


@query(
    "landing_phases",
    BASE
    + f""", lv AS (SELECT trial_id, max(v) FILTER (idx = takeoff - 1) AS vt FROM k WHERE onset < takeoff GROUP BY trial_id),
ld AS (SELECT *, sum(CASE WHEN idx > touchdown THEN 0.005e0 * ((f - w) + pf - w) / (w / {G}) ELSE 0e0 END) OVER (PARTITION BY trial_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - vt AS u
  FROM (SELECT *, lag(f) OVER (PARTITION BY trial_id ORDER BY idx) AS pf FROM m) JOIN lv USING (trial_id) WHERE idx >= touchdown),
le AS (SELECT trial_id, min(idx) AS landing_end FROM ld WHERE u >= 0 GROUP BY trial_id),
lp AS (SELECT trial_id, arg_min(idx, -f * 1000e0 + idx * 1e-9) AS impact_peak FROM ld JOIN le USING (trial_id) WHERE idx < landing_end GROUP BY trial_id),
bd AS (SELECT trial_id, idx, min(f) OVER z >= 0.95e0 * w AND max(f) OVER z <= 1.05e0 * w AS ok, count(*) OVER z AS c, touchdown FROM m WINDOW z AS (PARTITION BY trial_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)),
sb AS (SELECT trial_id, min(idx) + 1 AS stable FROM bd WHERE idx >= touchdown AND ok AND c = 2 GROUP BY trial_id)
SELECT lm.trial_id, landing_end, impact_peak, round((stable - touchdown) / 100e0, 6) AS seconds_to_stability FROM lm LEFT JOIN le USING (trial_id) LEFT JOIN lp USING (trial_id) LEFT JOIN sb USING (trial_id) WHERE touchdown IS NOT NULL AND onset < takeoff""",
)
@whole
def landing_phases(spark, sf_dir):
    """End of landing (velocity back at zero from minus the takeoff velocity), impact peak, and time to stability."""
    from ..functions.scans import integrated

    d = moving(spark, sf_dir).transform(answerable).transform(needs("touchdown"))
    d = d.withColumn("landing", integrated()(Q.acceleration(), c.touchdown, c.dt))
    d = d.withColumn("landing_end", T.find(F.col("landing"), ">=", A.at(F.col("velocity"), c.last), c.touchdown))
    return d.select(
        "trial_id",
        "code",
        "landing_end",
        A.argmax(c.force, c.touchdown, F.col("landing_end")).alias("impact_peak"),
        *rounded(seconds_to_stability=(P.stabilised(c.force, c.weight, c.touchdown, 2) - c.touchdown) * c.dt),
    )


GATES_SQL = (
    BASE
    + """, q AS (SELECT trial_id, any_value(w) AS w, any_value(sd) AS sd, max(abs(f - w)) FILTER (idx >= 100 AND idx < onset) AS tension, min(f) FILTER (idx >= 100 AND idx < onset) AS lowest, min(f) FILTER (idx < takeoff) AS deepest, any_value(onset) AS onset FROM m GROUP BY trial_id),
gates AS (SELECT trial_id, 'pretension_ceiling' AS gate, tension > 100 AS fired, round(tension, 6) AS observed FROM q
 UNION ALL SELECT trial_id, 'pretension_share', tension > 0.1e0 * w, round(tension, 6) FROM q
 UNION ALL SELECT trial_id, 'countermovement_contamination', lowest < w - 5 * sd, round(lowest, 6) FROM q
 UNION ALL SELECT trial_id, 'countermovement_jump', w - deepest > 250, round(w - deepest, 6) FROM q)
"""
)


def gate_rows(spark, sf_dir) -> DataFrame:
    """A row per trial and gate: whether it fired and what it saw. Every gate reports."""
    quiet = A.between(c.force, F.col("epoch_end"), c.onset)
    d = A.settled(
        placed(spark, sf_dir),
        tension=F.array_max(F.transform(quiet, lambda x: F.abs(x - c.weight))),
        lowest=F.array_min(quiet),
        depth=c.weight - F.array_min(A.between(c.force, 0, c.takeoff)),
    )
    row = lambda gate, fired, seen: F.struct(F.lit(gate).alias("gate"), fired.alias("fired"), F.round(seen, 6).alias("observed"))
    return d.select(
        "trial_id",
        F.inline(
            F.array(
                row("pretension_ceiling", F.col("tension") > 100, F.col("tension")),
                row("pretension_share", F.col("tension") > 0.1 * c.weight, F.col("tension")),
                row("countermovement_contamination", F.col("lowest") < c.weight - 5 * F.col("weight_sd"), F.col("lowest")),
                row("countermovement_jump", F.col("depth") > 250, F.col("depth")),
            )
        ),
    )


@query("validity_gates", GATES_SQL + "SELECT * FROM gates")
def validity_gates(spark, sf_dir):
    """Validity gates and jump type of every trial."""
    return gate_rows(spark, sf_dir)


@query("gate_tally", GATES_SQL + "SELECT gate, count(*) FILTER (fired) AS would_exclude, count(fired) AS of_trials, CASE WHEN gate = 'countermovement_jump' THEN 0 ELSE count(*) FILTER (fired) END AS excluded FROM gates GROUP BY gate")
def gate_tally(spark, sf_dir):
    """Per gate: how many trials it would exclude and, being applied, does; the jump type is a report only."""
    fired = F.count(F.when(F.col("fired"), 1))
    return gate_rows(spark, sf_dir).groupBy("gate").agg(
        fired.alias("would_exclude"),
        F.count("fired").alias("of_trials"),
        F.when(F.col("gate") == "countermovement_jump", F.lit(0).cast("long")).otherwise(fired).alias("excluded"),
    )


@query(
    "population",
    GATES_SQL + "SELECT trial_id FROM lm WHERE onset IS NOT NULL AND trial_id NOT IN (SELECT trial_id FROM gates WHERE fired AND gate = 'countermovement_contamination')",
)
def population(spark, sf_dir):
    """Trials with an answer, less those that an applied gate removes."""
    out = gate_rows(spark, sf_dir).where("fired AND gate = 'countermovement_contamination'").select("trial_id")
    return placed(spark, sf_dir).where(c.onset.isNotNull()).select("trial_id").join(out, "trial_id", "left_anti")


@query(
    "quality_signals",
    RESULTS_SQL
    + """SELECT trial_id, CASE WHEN height_flight IS NULL OR height_takeoff IS NULL THEN 'incomparable' WHEN abs(height_takeoff - height_flight) / height_flight > 0.2e0 THEN 'disagrees' ELSE 'agrees' END AS heights,
  CASE WHEN abs(height_takeoff - height_flight) / height_flight > 0.2e0 THEN CASE WHEN height_takeoff > height_flight THEN 'onset' ELSE 'takeoff' END END AS remedy,
  coalesce(onset + 3 = 100, false) AS onset_at_search_floor, coalesce(takeoff = 100, false) AS takeoff_at_search_floor, coalesce(onset >= takeoff, false) AS onset_not_before_takeoff FROM q""",
)
def quality_signals(spark, sf_dir):
    """Signals of a doubtful trial: heights that disagree and what to look at, landmarks at the search floor or out of order."""
    d = results_frame(spark, sf_dir)
    a, b = F.col("height_takeoff"), F.col("height_flight")
    apart = F.abs(a - b) / b > 0.2
    no = lambda x: F.coalesce(x, F.lit(False))
    return d.select(
        "trial_id",
        F.when(a.isNull() | b.isNull(), "incomparable").when(apart, "disagrees").otherwise("agrees").alias("heights"),
        F.when(apart, F.when(a > b, "onset").otherwise("takeoff")).alias("remedy"),
        no(c.onset + 3 == F.col("epoch_end")).alias("onset_at_search_floor"),
        no(c.takeoff == F.col("epoch_end")).alias("takeoff_at_search_floor"),
        no(c.onset >= c.takeoff).alias("onset_not_before_takeoff"),
    )


LONG = ["net_impulse", "takeoff_velocity", "height_takeoff", "height_flight", "rsi_modified"]


@query(
    "descriptions",
    RESULTS_SQL
    + ", u AS (SELECT trial_id, subject, onset, takeoff, touchdown, unnest(["
    + ", ".join(f"{{'quantity': '{n}', 'value': {n}}}" for n in LONG)
    + "], recursive := true) FROM q) SELECT trial_id, subject, quantity, round(value, 6) AS value, CASE WHEN value IS NULL THEN CASE WHEN takeoff IS NULL THEN 'no_takeoff' WHEN onset IS NULL THEN 'no_onset' WHEN touchdown IS NULL THEN 'no_touchdown' ELSE 'not_ordered' END END AS refusal FROM u",
)
def descriptions(spark, sf_dir):
    """Wide to long: a row per trial and quantity, an absent one with the reason."""
    d = results_frame(spark, sf_dir)
    reason = F.when(c.takeoff.isNull(), "no_takeoff").when(c.onset.isNull(), "no_onset").when(c.touchdown.isNull(), "no_touchdown").otherwise("not_ordered")
    d = d.withColumn("reason", reason).unpivot(["trial_id", "subject", "reason"], LONG, "quantity", "value")
    return d.select("trial_id", "subject", "quantity", F.round("value", 6).alias("value"), F.when(F.col("value").isNull(), F.col("reason")).alias("refusal"))


@query(
    "relation_round_trips",
    RESULTS_SQL
    + "SELECT kind, count(*) AS trials, count(onset) AS with_onset, round(sum(height_takeoff), 6) AS heights, round(sum(weight_sum), 6) AS weights, count(DISTINCT trial_id) AS ids FROM (SELECT *, w AS weight_sum FROM q) CROSS JOIN (SELECT unnest(['parquet', 'csv', 'json']) AS kind) GROUP BY kind",
)
def relation_round_trips(spark, sf_dir):
    """Results written as Parquet, CSV and JSON and read back: the same numbers from each."""
    d = store.written(results_frame(spark, sf_dir).select("trial_id", "onset", "weight", "height_takeoff"), "results")
    out = None
    for kind in ("parquet", "csv", "json"):
        r = store.round_trip(d, kind)
        out = r if out is None else out.unionByName(r)
    return out.groupBy("kind").agg(
        F.count("*").alias("trials"),
        F.count("onset").alias("with_onset"),
        F.round(F.sum("height_takeoff"), 6).alias("heights"),
        F.round(F.sum("weight"), 6).alias("weights"),
        F.countDistinct("trial_id").alias("ids"),
    )


@query(
    "refusal_codes",
    BASE
    + """, r AS (SELECT trial_id, 'no_takeoff' AS code FROM lm WHERE takeoff IS NULL UNION ALL SELECT trial_id, 'collapsed_band' FROM lm WHERE sd <= 0 UNION ALL SELECT trial_id, 'no_onset' FROM lm WHERE onset IS NULL AND sd > 0 UNION ALL SELECT trial_id, 'no_touchdown' FROM lm WHERE touchdown IS NULL)
SELECT trial_id, string_agg(DISTINCT code, ',' ORDER BY code) AS codes FROM r GROUP BY trial_id""",
)
def refusal_codes(spark, sf_dir):
    """Why a trial has blanks: its codes, sorted and joined."""
    d = placed(spark, sf_dir)
    flat = F.col("weight_sd") <= 0
    codes = F.array_compact(
        F.array(
            F.when(c.takeoff.isNull(), "no_takeoff"), F.when(flat, "collapsed_band"), F.when(c.onset.isNull() & ~flat, "no_onset"), F.when(c.touchdown.isNull(), "no_touchdown")
        )
    )
    return d.select("trial_id", F.array_join(F.array_sort(F.array_distinct(codes)), ",").alias("codes")).where("codes <> ''")


@query(
    "coverage",
    BASE + "SELECT count(*) AS trials, count(*) FILTER (onset < takeoff) AS computed, count(*) FILTER (takeoff IS NULL OR onset IS NULL OR touchdown IS NULL) AS with_codes, count(DISTINCT subject) AS subjects, sum(n)::BIGINT AS samples FROM lm",
)
def coverage(spark, sf_dir):
    """Counts of the run, in one pass."""
    return placed(spark, sf_dir).agg(
        F.count("*").alias("trials"),
        F.count(F.when(c.ordered, 1)).alias("computed"),
        F.count(F.when(c.takeoff.isNull() | c.onset.isNull() | c.touchdown.isNull(), 1)).alias("with_codes"),
        F.countDistinct("subject").alias("subjects"),
        F.sum(F.size("force")).cast("long").alias("samples"),
    )


@query(
    "provenance",
    BASE
    + """, p AS (SELECT trial_id, 'weighing=fixed_window;takeoff=absolute_force;onset=' || CASE WHEN sd > 0 THEN 'noise_relative' ELSE 'declined' END || ';touchdown=' || CASE WHEN touchdown IS NULL THEN 'none' ELSE 'return_to_plate' END AS chain FROM lm)
SELECT substr(sha256(chain), 1, 16) AS provenance_id, chain, count(*) AS trials FROM p GROUP BY chain""",
)
def provenance(spark, sf_dir):
    """Distinct chains of rules by the hash of their text, and how many trials went by each."""
    chain = F.concat(
        F.lit("weighing=fixed_window;takeoff=absolute_force;onset="),
        F.when(F.col("weight_sd") > 0, "noise_relative").otherwise("declined"),
        F.lit(";touchdown="),
        F.when(c.touchdown.isNull(), "none").otherwise("return_to_plate"),
    )
    d = placed(spark, sf_dir).select(chain.alias("chain")).groupBy("chain").agg(F.count("*").alias("trials"))
    return d.select(F.substring(F.sha2("chain", 256), 1, 16).alias("provenance_id"), "chain", "trials")


@query(
    "body_mass_join",
    BASE
    + f", bm AS (SELECT c_custkey % 20 AS subject, max(60e0 + c_nationkey) AS mass FROM customer WHERE c_custkey % 20 < 18 GROUP BY 1) SELECT lm.trial_id, lm.subject, round(w / {G} - mass, 6) AS bar_mass, mass IS NULL AS mass_missing FROM lm LEFT JOIN bm USING (subject)",
)
def body_mass_join(spark, sf_dir):
    """Body mass by athlete and the mass of what they hold; athletes without a mass are told."""
    mass = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 20 < 18").groupBy((F.col("c_custkey") % 20).alias("subject")).agg(F.max(60.0 + F.col("c_nationkey")).alias("mass"))
    d = placed(spark, sf_dir).select("trial_id", "subject", "weight").join(mass, "subject", "left")
    return d.select("trial_id", "subject", F.round(c.weight / G - F.col("mass"), 6).alias("bar_mass"), F.col("mass").isNull().alias("mass_missing"))


VARIANTS_SQL = (
    BASE
    + f""", w3 AS (SELECT trial_id, [min(idx) FILTER (w - 3 * sd > 0 AND hi < w - 3 * sd), min(idx) FILTER (w - 5 * sd > 0 AND hi < w - 5 * sd), min(idx) FILTER (w - 8 * sd > 0 AND hi < w - 8 * sd)] AS os
  FROM oq WHERE idx >= 100 AND idx < takeoff AND c = 3 AND sd > 0 GROUP BY trial_id),
vk AS (SELECT lm.trial_id, lm.subject, lm.takeoff, lm.w, [3, 5, 8][z] AS kk, os[z] AS o FROM lm LEFT JOIN w3 USING (trial_id) CROSS JOIN range(1, 4) AS r(z)),
vr AS (SELECT trial_id, subject, kk, bb, takeoff, w, CASE WHEN o IS NOT NULL THEN greatest(o - bb, 0) END AS o FROM vk CROSS JOIN (VALUES (0), (3)) AS z(bb)),
cl AS (SELECT trial_id, list(cf ORDER BY idx) AS cs, list(f ORDER BY idx) AS fs FROM (SELECT trial_id, idx, f, sum(f) OVER (PARTITION BY trial_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cf FROM s) GROUP BY trial_id),
hv AS (SELECT vr.trial_id, vr.subject, 'k' || kk || '_back' || bb AS rule, CASE WHEN o < takeoff THEN ((cs[takeoff] - cs[o + 1] + fs[o + 1] - 0.5e0 * (fs[o + 1] + fs[takeoff]) - (takeoff - 1 - o) * w) * 0.01e0 / (w / {G})) ** 2 / (2 * {G}) END AS value
  FROM vr JOIN cl USING (trial_id))
"""
)


#: The onset variants of the sweeps: deviations of the band, samples stepped back.
VARIANTS = [(k, back) for k in (3, 5, 8) for back in (0, 3)]


def variants_in_rows(spark, sf_dir, keep: list[str] = [], only: list[tuple[int, int]] = VARIANTS) -> DataFrame:  # noqa: B006
    """Jump height of every trial under each onset variant (k x step back), in an array `v` of the trial's row.

    Weighing and takeoff are placed once; the variants are found in one step.
    """
    heights = scans.onset_heights(only, 100, 3, G)(c.force, c.weight, F.col("weight_sd"), c.takeoff, c.dt)
    d = placed(spark, sf_dir).select("trial_id", "subject", *keep, heights.alias("_h"))
    rows = [F.struct(F.lit(f"k{k}_back{back}").alias("rule"), F.col(f"_h.k{k}_back{back}").alias("value")) for k, back in only]
    return d.select("trial_id", "subject", *keep, F.array(*rows).alias("v"))


def variants(spark, sf_dir) -> DataFrame:
    """The same, a row per trial and variant."""
    return variants_in_rows(spark, sf_dir).select("trial_id", "subject", F.inline("v"))


@query("sweep_variants", VARIANTS_SQL + "SELECT trial_id, subject, rule, round(value, 6) AS value FROM hv")
def sweep_variants(spark, sf_dir):
    """Every trial under every variant of a grid of rules."""
    return variants(spark, sf_dir).withColumn("value", F.round("value", 6))


@query(
    "sweep_headline",
    VARIANTS_SQL
    + ", h AS (SELECT trial_id, list_sort(list(value) FILTER (value IS NOT NULL)) AS v FROM hv GROUP BY trial_id) SELECT trial_id, coalesce(len(v), 0) AS counted, round(v[1], 6) AS least, round(v[len(v)], 6) AS greatest, round(v[len(v) // 2 + 1], 6) AS middle, round(CASE WHEN len(v) >= 2 THEN v[len(v)] - v[1] END, 6) AS spread, round(CASE WHEN len(v) >= 2 THEN 100 * (v[len(v)] - v[1]) / abs(v[len(v) // 2 + 1]) END, 4) AS percent FROM h",
)
def sweep_headline(spark, sf_dir):
    """How far the choice of rule moves each trial's number."""
    d = C.headline_in_rows(variants_in_rows(spark, sf_dir), "v")
    return d.select("trial_id", "counted", *rounded(**{n: F.col(n) for n in ("least", "greatest", "middle", "spread")}), F.round("percent", 4).alias("percent"))


@query(
    "sweep_cohort",
    VARIANTS_SQL + ", h AS (SELECT trial_id, max(value) - min(value) AS s, median(value) AS md FROM hv GROUP BY trial_id HAVING count(value) = 6) SELECT count(*) AS complete_trials, round(median(s), 6) AS median_spread, round(100 * median(s) / median(md), 4) AS percent_of_median FROM h",
)
def sweep_cohort(spark, sf_dir):
    """Median within-trial spread over the trials that every variant answers."""
    d = variants_in_rows(spark, sf_dir).select(F.transform("v", lambda x: x["value"]).alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    d = d.select(F.array_max("v") - F.array_min("v"), A.median(F.col("v"))).toDF("s", "md")
    both = store.written(d.select(F.inline(F.array(*[F.struct(F.lit(x).alias("what"), F.col(x).alias("x")) for x in ("s", "md")]))), "spreads")
    both = both.groupBy("what").agg(F.count("*").alias("n")).join(C.exact_quantiles(both, "what", "x", {"m": 0.5}), "what")
    of = lambda what: F.max(F.when(F.col("what") == what, F.col("m")))
    return both.agg(F.coalesce(F.max("n"), F.lit(0)).alias("complete_trials"), F.round(of("s"), 6).alias("median_spread"), F.round(100 * of("s") / of("md"), 4).alias("percent_of_median"))


@query(
    "rule_correlations",
    VARIANTS_SQL + "SELECT a.rule AS rule_a, b.rule AS rule_b, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM hv a JOIN hv b ON a.trial_id = b.trial_id AND a.rule < b.rule WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL",
)
def rule_correlations(spark, sf_dir):
    """Pearson's r of every pair of rules over the trials both answer: pairs are made inside a trial's row."""
    d = variants_in_rows(spark, sf_dir).select(F.filter("v", lambda x: x["value"].isNotNull()).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["rule"] > a["rule"]), lambda b: F.struct(a["rule"].alias("rule_a"), b["rule"].alias("rule_b"), a["value"].alias("x"), b["value"].alias("y")))))
    return d.select(F.inline(pairs)).groupBy("rule_a", "rule_b").agg(F.count("*").alias("n"), F.round(F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")), 6).alias("r"))


@query(
    "failure_rates",
    VARIANTS_SQL + "SELECT rule, count(*) AS trials, count(*) FILTER (value IS NULL) AS failed, count(*) FILTER (value > 0.3e0) AS over, round(100e0 * count(*) FILTER (value > 0.3e0) / count(*), 6) AS percent_over, round(median(value), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS most FROM hv GROUP BY rule",
)
def failure_rates(spark, sf_dir):
    """Per rule: failures, values over a limit, and the upper tail."""
    over = F.count(F.when(F.col("value") > 0.3, 1))
    d = store.written(variants(spark, sf_dir).select("rule", "value"), "variants")
    q = C.exact_quantiles(d, "rule", "value", {"median": 0.5, "p95": 0.95})
    found = d.groupBy("rule").agg(
        F.count("*").alias("trials"),
        (F.count("*") - F.count("value")).alias("failed"),
        over.alias("over"),
        F.round(100.0 * over / F.count("*"), 6).alias("percent_over"),
        F.round(F.max("value"), 6).alias("most"),
    )
    return found.join(q, "rule", "left").withColumns({x: F.round(x, 6) for x in ("median", "p95")})


RANKED_SQL = (
    RESULTS_SQL
    + """, ra AS (SELECT q.trial_id, q.subject, q.occasion, height_takeoff AS value, round(peak, 9) AS rank FROM q JOIN (SELECT trial_id, max(f) AS peak FROM m WHERE idx < takeoff GROUP BY trial_id) USING (trial_id) WHERE height_takeoff IS NOT NULL),
rk AS (SELECT *, row_number() OVER (PARTITION BY subject, occasion ORDER BY rank DESC, trial_id) AS n, lead(rank) OVER (PARTITION BY subject, occasion ORDER BY rank DESC, trial_id) AS nx FROM ra)
"""
)


def ranked(spark, sf_dir) -> DataFrame:
    d = results_frame(spark, sf_dir).where("height_takeoff IS NOT NULL")
    return d.select("trial_id", "subject", "occasion", F.col("height_takeoff").alias("value"), F.round("peak", 9).alias("rank"))


def _aggregate(rule: str, takes: int, needs: int) -> None:
    @query(
        f"aggregate_{rule}",
        RANKED_SQL
        + f""", g AS (SELECT subject, occasion, count(*) AS trials, coalesce(max(CASE WHEN n = {takes} THEN (rank = nx)::INT END), 0) AS tied, avg(value) FILTER (n <= {takes}) AS m, stddev_samp(value) FILTER (n <= {takes}) AS s FROM rk GROUP BY subject, occasion)
SELECT subject, occasion, trials, CASE WHEN trials < {needs} THEN 'too_few_trials' WHEN tied = 1 THEN 'tied_at_boundary' ELSE 'ok' END AS status,
  CASE WHEN trials >= {needs} AND tied = 0 THEN round(m, 6) END AS value, CASE WHEN trials >= {needs} AND tied = 0 AND {takes} > 1 THEN round(s, 6) END AS dispersion FROM g""",
    )
    def run(spark, sf_dir):
        d = C.aggregate_trials(ranked(spark, sf_dir), ["subject", "occasion"], "rank", "value", rule)
        return d.withColumns({"value": F.round("value", 6), "dispersion": F.round("dispersion", 6)})


for _rule, (_takes, _needs) in C.RULES.items():
    _aggregate(_rule, _takes, max(_takes, _needs))


@query(
    "group_counts",
    RANKED_SQL + "SELECT subject, occasion, grouping(subject, occasion) AS kind, count(*) AS trials, round(avg(value), 6) AS value FROM ra GROUP BY GROUPING SETS ((subject), (subject, occasion), ())",
)
def group_counts(spark, sf_dir):
    """Means per athlete, per session and for the run, in one pass."""
    d = ranked(spark, sf_dir).groupingSets([["subject"], ["subject", "occasion"], []], "subject", "occasion")
    return d.agg(F.grouping_id().alias("kind"), F.count("*").alias("trials"), F.round(F.avg("value"), 6).alias("value")).select("subject", "occasion", "kind", "trials", "value")


@query(
    "agreement",
    RESULTS_SQL
    + """, x AS (SELECT height_takeoff AS a, height_flight AS b FROM q WHERE height_takeoff IS NOT NULL AND height_flight IS NOT NULL),
z AS (SELECT count(*) AS n, avg(b - a) AS bias, stddev_samp(b - a) AS sd, covar_samp(a, b) AS cv, stddev_samp(b) AS sb, stddev_samp(a) AS sa, avg(a) AS ma, avg(b) AS mb FROM x),
y AS (SELECT *, cv / nullif(sa * sb, 0) AS r, sign(cv / nullif(sa * sb, 0)) * sb / nullif(sa, 0) AS slope FROM z)
SELECT n, """
    + sql_rounded(bias="bias", sd="sd", lower="bias - 1.96e0 * sd", upper="bias + 1.96e0 * sd", r="r", slope="slope", intercept="mb - slope * ma")
    + " FROM y",
)
def agreement(spark, sf_dir):
    """Limits of agreement, correlation and least-products line of the two heights."""
    d = C.limits_of_agreement(results_frame(spark, sf_dir), "height_takeoff", "height_flight")
    return d.select("n", *rounded(**{x: F.col(x) for x in ("bias", "sd", "lower", "upper", "r", "slope", "intercept")}))


@query("agreement_bootstrap")
def agreement_bootstrap(spark, sf_dir):
    """Resampled intervals of the least-products line."""
    d = results_frame(spark, sf_dir).select("trial_id", "height_takeoff", "height_flight")
    return C.bootstrap_products_line(d, "trial_id", "height_takeoff", "height_flight", 5000)


@query(
    "reliability_cv",
    RANKED_SQL + ", p AS (SELECT subject, stddev_samp(value) AS s, avg(value) AS m FROM ra GROUP BY subject HAVING count(value) >= 2 AND avg(value) <> 0) SELECT round(avg(100 * s / m), 6) AS cv_percent, count(*) AS subjects, 'within_session' AS interval FROM p",
)
def reliability_cv(spark, sf_dir):
    """Mean within-athlete coefficient of variation, with the interval it is declared for."""
    d = C.coefficient_of_variation(ranked(spark, sf_dir), "subject", "value")
    return d.select(F.round("cv_percent", 6).alias("cv_percent"), "subjects", F.lit("within_session").alias("interval"))


@query(
    "reliability_icc",
    RANKED_SQL
    + """, gr AS (SELECT * FROM (SELECT subject, value, row_number() OVER (PARTITION BY subject ORDER BY trial_id) AS col FROM ra) WHERE col <= 2 AND subject IN (SELECT subject FROM ra GROUP BY subject HAVING count(*) >= 2)),
mu AS (SELECT avg(value) AS g, count(DISTINCT subject) AS n FROM gr), sm AS (SELECT subject, avg(value) AS a FROM gr GROUP BY subject), cm AS (SELECT col, avg(value) AS b FROM gr GROUP BY col),
ms AS (SELECT any_value(n) AS n, 2 * sum(DISTINCT 0) + (SELECT 2 * sum((a - g) ** 2) / (count(*) - 1) FROM sm, mu) AS bms, (SELECT any_value(n) * sum((b - g) ** 2) / 1 FROM cm, mu) AS mms, sum((value - a - b + g) ** 2) / (any_value(n) - 1) AS res FROM gr JOIN sm USING (subject) JOIN cm USING (col), mu)
SELECT n AS subjects, 2::BIGINT AS measurements, round((bms - res) / (bms + res), 6) AS icc_consistency, round((bms - res) / (bms + res + 2 * (mms - res) / n), 6) AS icc_agreement FROM ms""",
)
def reliability_icc(spark, sf_dir):
    """Intraclass correlations over the first two trials of every athlete that has two."""
    from pyspark.sql import Window

    w = Window.partitionBy("subject").orderBy("trial_id")
    d = ranked(spark, sf_dir).select("trial_id", "subject", "value")
    d = d.withColumn("col", F.row_number().over(w)).withColumn("k", F.count("*").over(Window.partitionBy("subject"))).where("col <= 2 AND k >= 2")
    return C.intraclass(d, "subject", "col", "value").withColumns({x: F.round(x, 6) for x in ("icc_consistency", "icc_agreement")})


@query(
    "paired_rules",
    VARIANTS_SQL + "SELECT trial_id, max(value) FILTER (rule = 'k5_back3') IS NOT NULL AS first_given, round(max(value) FILTER (rule = 'k5_back3'), 6) AS first_value, round(max(value) FILTER (rule = 'k8_back0'), 6) AS second_value FROM hv WHERE rule IN ('k5_back3', 'k8_back0') GROUP BY trial_id HAVING count(value) = 2",
)
def paired_rules(spark, sf_dir):
    """Trials that two named rules both answer, side by side."""
    d = variants_in_rows(spark, sf_dir, only=[(5, 3), (8, 0)])
    d = A.settled(d.select("trial_id", "v"), k5_back3=F.get("v", F.lit(0))["value"], k8_back0=F.get("v", F.lit(1))["value"])
    d = d.where("k5_back3 IS NOT NULL AND k8_back0 IS NOT NULL")
    return d.select("trial_id", F.col("k5_back3").isNotNull().alias("first_given"), F.round("k5_back3", 6).alias("first_value"), F.round("k8_back0", 6).alias("second_value"))


for _name in ("phase_boundaries", "landing_phases"):
    ORACLES[_name] = whole_sql(ORACLES[_name])
