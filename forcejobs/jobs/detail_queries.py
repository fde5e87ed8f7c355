"""Registered queries on the details of rules: ties, smoothed drop-offs, lift ends, picks, clean sweeps, counts of a run."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cols as c
from ..functions import scans
from ..functions import traces as T
from ..operators import cohort as C
from ..operators import landmarks as L
from ..operators import phases as P
from ..sources import files
from ..sources.trials import SAMPLES_CTE, trials
from .cohort_queries import GATES_SQL, LONG, RANKED_SQL, VARIANTS_SQL, gate_rows, ranked, variants_in_rows
from .phase_queries import TOPS, ZERO
from .run_queries import NAME
from .trial_queries import BASE, RESULTS_SQL, RUNS, answerable, moving, needs, placed, results_frame, rounded, whole, whole_sql

G = L.GRAVITY
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query(
    "weighing_ties",
    f"""WITH {SAMPLES_CTE}, md AS (SELECT trial_id, median(f) AS md FROM s GROUP BY trial_id),
x AS (SELECT s.trial_id, idx, round(var_pop(f) OVER z, 9) AS v, avg(f) OVER z AS a, min(f) OVER z <= 0.025e0 * md AS bad, count(*) OVER z AS c FROM s JOIN md USING (trial_id) WINDOW z AS (PARTITION BY s.trial_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
b AS (SELECT trial_id, min(v) AS v FROM x WHERE c = 50 AND NOT bad GROUP BY trial_id)
SELECT trial_id, count(*) AS tied, round(min(a), 6) AS tied_low, round(max(a), 6) AS tied_high FROM x JOIN b USING (trial_id) WHERE c = 50 AND NOT bad AND x.v = b.v GROUP BY trial_id""",
)
def weighing_ties(spark, sf_dir):
    """How many windows are equally steady, and the range of weights among them."""
    d = trials(spark, sf_dir).withColumn("b", scans.steadiest_window(50)("force"))
    return d.where("b.start IS NOT NULL").select("trial_id", F.col("b.tied").cast("long").alias("tied"), *rounded(tied_low=F.col("b.tied_low"), tied_high=F.col("b.tied_high")))


@query(
    "dropoff_smoothed",
    BASE
    + """, c2 AS (SELECT trial_id, idx, f, onset, takeoff, n, lead(f, 2) OVER (PARTITION BY trial_id ORDER BY idx) - f AS rise, avg(f) OVER (PARTITION BY trial_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 5 FOLLOWING) AS a FROM m WHERE onset < takeoff),
ed AS (SELECT trial_id, max(a) FILTER (idx = 4) AS head, max(a) FILTER (idx = n - 6) AS tail FROM c2 GROUP BY trial_id),
sm AS (SELECT trial_id, idx, CASE WHEN idx < 4 THEN head WHEN idx > n - 6 THEN tail ELSE a END AS g FROM c2 JOIN ed USING (trial_id)),
st AS (SELECT trial_id, max(rise) AS mr FROM c2 WHERE idx BETWEEN onset AND takeoff - 2 GROUP BY trial_id),
sx AS (SELECT trial_id, min(idx) AS steep FROM c2 JOIN st USING (trial_id) WHERE idx BETWEEN onset AND takeoff - 2 AND rise = mr GROUP BY trial_id),
rm AS (SELECT trial_id, idx, g, steep, max(g) OVER (PARTITION BY trial_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS top FROM sm JOIN sx USING (trial_id) WHERE idx >= steep)
SELECT sx.trial_id, steep AS steepest, dropoff FROM sx LEFT JOIN (SELECT trial_id, min(idx) AS dropoff FROM rm WHERE idx > steep AND g < 0.95e0 * top GROUP BY trial_id) USING (trial_id)""",
)
@whole
def dropoff_smoothed(spark, sf_dir):
    """End of the window where force, smoothed over 100 ms, is under 95 % of its running maximum since the steepest rise."""
    d = placed(spark, sf_dir).transform(answerable)
    d = d.withColumns({"steepest": T.steepest(c.force, 2, c.onset, c.takeoff)["start"], "smooth": T.moving_average(c.force, 10)})
    return d.select("trial_id", "code", "steepest", P.dropoff(F.col("smooth"), F.col("steepest")).alias("dropoff"))


@query(
    "lift_ends",
    BASE
    + TOPS
    + ZERO
    + """, fz AS (SELECT trial_id, min(idx) AS fall FROM m JOIN tp USING (trial_id) WHERE idx >= top AND idx < n AND idx <= takeoff + 5 AND f <= 0 GROUP BY trial_id),
nl AS (SELECT trial_id, idx, v, lag(v) OVER y AS pv, lead(v) OVER y AS nv FROM k WHERE onset < takeoff WINDOW y AS (PARTITION BY trial_id ORDER BY idx)),
sa AS (SELECT trial_id, min(idx) AS crest FROM nl JOIN zv USING (trial_id) JOIN lm USING (trial_id) WHERE idx > zero AND idx < n AND v > pv AND NOT coalesce(nv > v, false) GROUP BY trial_id),
sb AS (SELECT trial_id, min(idx) AS dip FROM nl JOIN sa USING (trial_id) JOIN lm USING (trial_id) WHERE idx > crest AND idx < n AND v < pv AND NOT coalesce(nv < v, false) GROUP BY trial_id)
SELECT trial_id, 120 AS stated_start, CASE WHEN fall > e.top THEN fall END AS end_at_no_force, CASE WHEN dip IS NOT NULL THEN crest END AS sticking_start, dip AS sticking_stop FROM e LEFT JOIN fz USING (trial_id) LEFT JOIN sa USING (trial_id) LEFT JOIN sb USING (trial_id)""",
)
@whole
def lift_ends(spark, sf_dir):
    """A lift from a stated start to where force is gone, shortly past takeoff; and the sticking region of velocity after it turns upward."""
    v = F.col("velocity")
    d = moving(spark, sf_dir).transform(answerable)
    d = d.withColumns({"zero": P.velocity_crossing(v, c.onset, c.takeoff), "top": A.argmax(c.force, c.onset, c.takeoff)}).transform(needs("zero"))
    d = d.withColumn("st", P.sticking_region(v, F.col("zero"), F.size(v)))
    fall = T.find(c.force, "<=", 0.0, F.col("top"), F.least(c.takeoff + 6, F.size(c.force)))
    return d.select("trial_id", "code", F.lit(120).alias("stated_start"), F.when(fall > F.col("top"), fall).alias("end_at_no_force"), F.col("st.start").alias("sticking_start"), F.col("st.stop").alias("sticking_stop"))


@query(
    "flight_window_pick",
    f"""WITH {SAMPLES_CTE}, {RUNS}, w AS (SELECT trial_id, start, stop - start + 1 AS len, (stop - start + 1) / 100e0 BETWEEN 0.1e0 AND 2e0 AS ok FROM runs)
SELECT trial_id, count(*) AS considered, count(*) FILTER (NOT ok) AS rejected, min(start) FILTER (ok) AS first_accepted, arg_max(start, len * 1000 - start) FILTER (ok) AS longest_accepted FROM w GROUP BY trial_id""",
)
def flight_window_pick(spark, sf_dir):
    """Low-force runs with the length of a flight: the first and the longest, how many were looked at and rejected."""
    d = trials(spark, sf_dir).select("trial_id", A.runs(c.force, L.low(20.0)).alias("runs"))
    seconds = lambda r: (r["end"] - r["start"] + 1) / 100.0
    d = A.settled(d, ok=F.filter("runs", lambda r: seconds(r).between(0.1, 2.0))).where(F.size("runs") > 0)
    longest = F.array_max(F.transform("ok", lambda r: F.struct((r["end"] - r["start"]).alias("n"), (-r["start"]).alias("back"))))
    return d.select(
        "trial_id",
        F.size("runs").cast("long").alias("considered"),
        (F.size("runs") - F.size("ok")).cast("long").alias("rejected"),
        F.get("ok", F.lit(0))["start"].alias("first_accepted"),
        (-longest["back"]).alias("longest_accepted"),
    )


FLAGGED_SQL = VARIANTS_SQL + f", fl AS (SELECT trial_id, {G} * ((touchdown - takeoff) / 100e0) ** 2 / 8 AS hf FROM lm), hg AS (SELECT hv.*, coalesce(abs(value - hf) / hf > 0.2e0, false) AS flagged FROM hv JOIN fl USING (trial_id))"


def flagged(spark, sf_dir):
    """Variants in a trial's row, each with whether its height disagrees with the height by flight."""
    hf = G * F.pow((c.touchdown - c.takeoff) * c.dt, F.lit(2)) / 8
    d = variants_in_rows(spark, sf_dir, keep=["takeoff", "touchdown", "sample_rate_hz"]).withColumn("hf", hf)
    no = lambda x: F.coalesce(F.abs(x["value"] - F.col("hf")) / F.col("hf") > 0.2, F.lit(False))
    return d.select("trial_id", F.transform("v", lambda x: F.struct(x["rule"].alias("rule"), x["value"].alias("value"), no(x).alias("flagged"))).alias("v"))


@query(
    "sweep_clean_headline",
    FLAGGED_SQL
    + """, h AS (SELECT trial_id, count(*) FILTER (value IS NOT NULL AND flagged) AS excluded, list_sort(list(value) FILTER (value IS NOT NULL AND NOT flagged)) AS v FROM hg GROUP BY trial_id)
SELECT trial_id, excluded, coalesce(len(v), 0) AS clean_counted, round(v[len(v) // 2 + 1], 6) AS clean_middle, round(CASE WHEN len(v) >= 2 THEN v[len(v)] - v[1] END, 6) AS clean_spread FROM h""",
)
def sweep_clean_headline(spark, sf_dir):
    """The headline of a sweep without the variants whose height disagrees with the height by flight."""
    d = flagged(spark, sf_dir)
    clean = C.headline_in_rows(d.select("trial_id", F.filter("v", lambda x: ~x["flagged"]).alias("v"), F.size(F.filter("v", lambda x: x["value"].isNotNull() & x["flagged"])).cast("long").alias("excluded")), "v", "trial_id", ["excluded"])
    return clean.select("trial_id", "excluded", F.col("counted").alias("clean_counted"), *rounded(clean_middle=F.col("middle"), clean_spread=F.col("spread")))


@query(
    "rule_correlations_masked",
    FLAGGED_SQL
    + " SELECT a.rule AS rule_a, b.rule AS rule_b, count(*) AS n, round(corr(a.value, b.value), 6) AS r FROM hg a JOIN hg b ON a.trial_id = b.trial_id AND a.rule < b.rule WHERE a.value IS NOT NULL AND b.value IS NOT NULL AND NOT a.flagged AND NOT b.flagged GROUP BY ALL",
)
def rule_correlations_masked(spark, sf_dir):
    """Pearson's r of every pair of rules over the trials both answer without a disagreement."""
    d = flagged(spark, sf_dir).select(F.filter("v", lambda x: x["value"].isNotNull() & ~x["flagged"]).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["rule"] > a["rule"]), lambda b: F.struct(a["rule"].alias("rule_a"), b["rule"].alias("rule_b"), a["value"].alias("x"), b["value"].alias("y")))))
    return d.select(F.inline(pairs)).groupBy("rule_a", "rule_b").agg(F.count("*").alias("n"), F.round(F.try_divide(F.covar_samp("x", "y"), F.stddev_samp("x") * F.stddev_samp("y")), 6).alias("r"))


@query(
    "aggregate_subjects",
    RANKED_SQL
    + """, rs AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY rank DESC, trial_id) AS k, lead(rank) OVER (PARTITION BY subject ORDER BY rank DESC, trial_id) AS kx FROM ra),
g AS (SELECT subject, count(*) AS trials, coalesce(max(CASE WHEN k = 3 THEN (rank = kx)::INT END), 0) AS tied, avg(value) FILTER (k <= 3) AS m, stddev_samp(value) FILTER (k <= 3) AS s FROM rs GROUP BY subject)
SELECT subject, trials, CASE WHEN trials < 5 THEN 'too_few_trials' WHEN tied = 1 THEN 'tied_at_boundary' ELSE 'ok' END AS status, CASE WHEN trials >= 5 AND tied = 0 THEN round(m, 6) END AS value, CASE WHEN trials >= 5 AND tied = 0 THEN round(s, 6) END AS dispersion FROM g""",
)
def aggregate_subjects(spark, sf_dir):
    """The mean of the best three of at least five trials of an athlete, all occasions pooled."""
    d = C.aggregate_trials(ranked(spark, sf_dir), ["subject"], "rank", "value", "mean_of_best_three_of_at_least_five")
    return d.withColumns({"value": F.round("value", 6), "dispersion": F.round("dispersion", 6)})


@query(
    "unreadable_trials",
    BASE + "SELECT trial_id, CASE WHEN trial_id % 97 = 0 THEN NULL ELSE takeoff END AS takeoff, CASE WHEN trial_id % 97 = 0 THEN NULL ELSE round(w, 6) END AS weight, CASE WHEN trial_id % 97 = 0 THEN 'unreadable' WHEN takeoff IS NULL THEN 'no_takeoff' WHEN onset IS NULL THEN 'no_onset' END AS code FROM lm",
)
def unreadable_trials(spark, sf_dir):
    """A trial whose samples cannot be read stays in the results as a row with a code; it does not stop the others."""
    force = F.when(F.col("trial_id") % 97 != 0, F.col("force"))
    d = L.place(trials(spark, sf_dir).withColumn("force", force))
    code = F.when(F.col("force").isNull(), "unreadable").when(c.takeoff.isNull(), "no_takeoff").when(c.onset.isNull(), "no_onset")
    return d.select("trial_id", "takeoff", *rounded(weight=c.weight), code.alias("code"))


MASSES = "SELECT c_custkey % 25 AS subject, max(60e0 + c_nationkey) AS mass FROM customer WHERE c_custkey % 25 <> 3 GROUP BY 1"


@query(
    "body_mass_refusals",
    f"WITH {SAMPLES_CTE}, bm AS ({MASSES}), su AS (SELECT DISTINCT subject FROM o) SELECT subject, 'mass_without_trials' AS code FROM bm WHERE subject NOT IN (SELECT subject FROM su) UNION ALL SELECT subject, 'trials_without_mass' FROM su WHERE subject NOT IN (SELECT subject FROM bm)",
)
def body_mass_refusals(spark, sf_dir):
    """Masses that name no athlete of the run, and athletes without a mass: either refuses the run."""
    mass = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 25 <> 3").select((F.col("c_custkey") % 25).alias("subject")).distinct()
    held = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") % 20).alias("subject")).distinct()
    lost = mass.join(held, "subject", "left_anti").withColumn("code", F.lit("mass_without_trials"))
    return lost.unionByName(held.join(mass, "subject", "left_anti").withColumn("code", F.lit("trials_without_mass")))


@query(
    "object_mass",
    BASE
    + f", bm AS ({MASSES}) SELECT trial_id, round(mass, 6) AS body_mass, round(w / {G}, 6) AS system_mass, CASE WHEN w / {G} - mass >= 0 THEN round(w / {G} - mass, 6) END AS bar_mass FROM lm LEFT JOIN bm USING (subject)",
)
def object_mass(spark, sf_dir):
    """Mass of the body, of body and bar, and of the bar, which is declined where it would be negative."""
    mass = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_custkey % 25 <> 3").groupBy((F.col("c_custkey") % 25).alias("subject")).agg(F.max(60.0 + F.col("c_nationkey")).alias("mass"))
    bar = c.weight / G - F.col("mass")
    d = placed(spark, sf_dir).select("trial_id", "subject", "weight").join(mass, "subject", "left")
    return d.select("trial_id", *rounded(body_mass=F.col("mass"), system_mass=c.weight / G, bar_mass=F.when(bar >= 0, bar)))


@query("descriptions_wide", RESULTS_SQL + "SELECT trial_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in LONG) + " FROM q")
def descriptions_wide(spark, sf_dir):
    """The long relation turned back into a column for each quantity."""
    d = results_frame(spark, sf_dir).unpivot(["trial_id"], LONG, "quantity", "value")
    wide = d.groupBy("trial_id").pivot("quantity", LONG).agg(F.max("value"))
    return wide.select("trial_id", *rounded(**{n: F.col(n) for n in LONG}))


@query(
    "run_coverage",
    GATES_SQL
    + f""", nm AS (SELECT trial_id, {NAME} AS name FROM lm), st AS (SELECT trial_id, CASE WHEN NOT suffix(name, '.force.txt') THEN 'without_suffix' WHEN trial_id % 17 = 0 THEN 'unidentified' ELSE 'ok' END AS st FROM nm),
ex AS (SELECT DISTINCT trial_id FROM gates WHERE fired AND gate = 'pretension_ceiling')
SELECT count(*) AS files_found, count(*) FILTER (st = 'without_suffix') AS without_suffix, count(*) FILTER (st = 'unidentified') AS unidentified, count(*) FILTER (st = 'ok') AS trials, count(*) FILTER (st = 'ok' AND onset < takeoff) AS computed,
  count(*) FILTER (st = 'ok' AND (takeoff IS NULL OR onset IS NULL)) AS refused, count(*) FILTER (st = 'ok' AND trial_id IN (SELECT trial_id FROM ex)) AS excluded FROM lm JOIN st USING (trial_id)""",
)
def run_coverage(spark, sf_dir):
    """Counts of a run from files found to trials computed, refused and excluded; they add up."""
    d = placed(spark, sf_dir).withColumn("name", F.expr(NAME))
    d = files.identify(d.drop("subject"), "name", "AT{subject}_{trial}", ".force.txt").select("trial_id", "status", "onset", "takeoff")
    out = gate_rows(spark, sf_dir).where("fired AND gate = 'pretension_ceiling'").select("trial_id", F.lit(True).alias("out"))
    d = d.join(out, "trial_id", "left")
    ok = F.col("status") == "ok"
    n = lambda test: F.count(F.when(test, 1))
    return d.agg(
        F.count("*").alias("files_found"), n(F.col("status") == "without_suffix").alias("without_suffix"), n(F.col("status") == "unidentified").alias("unidentified"),
        n(ok).alias("trials"), n(ok & c.ordered).alias("computed"), n(ok & (c.takeoff.isNull() | c.onset.isNull())).alias("refused"), n(ok & F.col("out")).alias("excluded"),
    )


@query(
    "read_modes",
    f"WITH {SAMPLES_CTE} SELECT trial_id, m.mode, count(*) AS rows, (CASE WHEN m.mode = 'row' THEN 1 ELSE 0 END)::BIGINT AS blank_lines, round(sum(f), 4) AS total FROM s CROSS JOIN (VALUES ('spaces'), ('row')) AS m(mode) GROUP BY ALL",
)
def read_modes(spark, sf_dir):
    """Files whose fields are parted by white space, and files with one number to a row."""
    d = trials(spark, sf_dir).select("trial_id", "force")
    spaces = files.text_lines(c.force, "  {i} \t {x}")
    row = files.text_lines(c.force, "{x}", "\n")
    out = None
    for mode, text, mark, index in (("spaces", spaces, None, 1), ("row", row, "", 0)):
        e = files.read_column(d.select("trial_id", text.alias("text")), "text", mark, index)
        e = e.select("trial_id", F.lit(mode).alias("mode"), F.size("values").cast("long").alias("rows"), "blank_lines", F.round("total", 4).alias("total"))
        out = e if out is None else out.unionByName(e)
    return out


@query(
    "suffix_walk",
    f"""WITH {SAMPLES_CTE}, n AS (SELECT k, CASE WHEN k % 13 = 0 THEN 'notes_' || k || '.csv' WHEN k % 5 = 0 THEN 'T' || k || '.txt' ELSE 'T' || k || '.force.txt' END AS name FROM o)
SELECT k AS trial_id, CASE WHEN suffix(name, '.force.txt') THEN '.force.txt' WHEN suffix(name, '.txt') THEN '.txt' END AS suffix, CASE WHEN suffix(name, '.force.txt') THEN substr(name, 1, length(name) - 10) WHEN suffix(name, '.txt') THEN substr(name, 1, length(name) - 4) END AS stem FROM n""",
)
def suffix_walk(spark, sf_dir):
    """Each file's suffix among the declared ones, the longest first, and its stem; a file without one keeps its row."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("trial_id"))
    k = F.col("trial_id")
    name = F.when(k % 13 == 0, F.concat(F.lit("notes_"), k, F.lit(".csv"))).when(k % 5 == 0, F.concat(F.lit("T"), k, F.lit(".txt"))).otherwise(F.concat(F.lit("T"), k, F.lit(".force.txt")))
    suffix, stem = files.longest_suffix(name, [".txt", ".force.txt"])
    return d.select("trial_id", suffix.alias("suffix"), stem.alias("stem"))


@query(
    "propulsion_split",
    BASE
    + TOPS
    + ZERO
    + """, fa AS (SELECT trial_id, min(idx) AS fall FROM m JOIN tp USING (trial_id) WHERE idx BETWEEN top AND takeoff AND f <= w GROUP BY trial_id),
sp AS (SELECT e.trial_id, e.zero, e.takeoff, e.zero + (e.takeoff - e.zero) // 2 AS half, CASE WHEN fall > e.top THEN fall END AS fall FROM e LEFT JOIN fa USING (trial_id))
SELECT trial_id, CASE WHEN half > zero AND half < takeoff THEN half END AS by_time, CASE WHEN fall > zero AND fall < takeoff THEN fall END AS by_force, coalesce(fall <= zero OR fall >= takeoff, false) AS force_refused FROM sp""",
)
@whole
def propulsion_split(spark, sf_dir):
    """Propulsion parted in two by time and by force falling through the weight; a part on or outside its ends is refused."""
    d = moving(spark, sf_dir).transform(answerable)
    d = d.withColumns({"zero": P.velocity_crossing(F.col("velocity"), c.onset, c.takeoff), "top": A.argmax(c.force, c.onset, c.takeoff)}).transform(needs("zero"))
    d = d.withColumns({"half": F.col("zero") + F.floor((c.takeoff - F.col("zero")) / 2).cast("int"), "fall": P.falling_crossing(c.force, c.weight, F.col("top"), c.takeoff)})
    inside = lambda x: (F.col(x) > F.col("zero")) & (F.col(x) < c.takeoff)
    return d.select("trial_id", "code", F.when(inside("half"), F.col("half")).alias("by_time"), F.when(inside("fall"), F.col("fall")).alias("by_force"), F.coalesce(~inside("fall"), F.lit(False)).alias("force_refused"))


@query(
    "velocity_anchors",
    BASE
    + """, a AS (SELECT trial_id, max(v) FILTER (idx = takeoff - 1) AS last, max(v) FILTER (idx = onset) AS first, max(v) FILTER (idx = onset + 10) AS mid, any_value(takeoff - 1 - onset) AS span FROM k WHERE onset < takeoff GROUP BY trial_id)
SELECT trial_id, round(last - mid, 6) AS single_point, round(last - mid + 0.1e0, 6) AS stated_value, round(mid - first - (last - first) * 10 / span, 6) AS two_point FROM a WHERE mid IS NOT NULL AND span > 10""",
)
@whole
def velocity_anchors(spark, sf_dir):
    """Takeoff velocity anchored at zero or at a stated value ten samples after onset, and there with a line between both ends taken out."""
    d = moving(spark, sf_dir).transform(answerable).transform(needs(F.when(c.last - c.onset > 10, 1)))
    v = lambda i: A.at(F.col("velocity"), i)
    first, mid, last = v(c.onset), v(c.onset + 10), v(c.last)
    return d.select("trial_id", "code", *rounded(single_point=last - mid, stated_value=last - mid + 0.1, two_point=mid - first - (last - first) * 10 / (c.last - c.onset)))


@query(
    "registration_coverage",
    BASE
    + """, lv AS (SELECT trial_id, min(f) AS lf, any_value(onset) AS onset, any_value(takeoff) AS takeoff FROM m WHERE onset < takeoff AND idx >= onset AND idx < takeoff GROUP BY trial_id),
la AS (SELECT trial_id, min(idx) - any_value(lv.onset) AS place, any_value(lv.takeoff - lv.onset) AS n FROM m JOIN lv USING (trial_id) WHERE idx >= lv.onset AND idx < lv.takeoff AND f = lf GROUP BY trial_id)
SELECT count(*) AS curves, count(*) FILTER (place > 0 AND place < n - 1) AS with_landmark, count(*) FILTER (NOT (place > 0 AND place < n - 1)) AS without_landmark, round(avg(place / (n - 1)::DOUBLE) FILTER (place > 0 AND place < n - 1), 6) AS mean_place FROM la""",
)
def registration_coverage(spark, sf_dir):
    """How many movements have the landmark that a registration needs inside them, and its mean relative place."""
    d = placed(spark, sf_dir).where(c.ordered).select((A.argmin(c.force, c.onset, c.takeoff) - c.onset).alias("at"), (c.takeoff - c.onset).alias("n"))
    held = (F.col("at") > 0) & (F.col("at") < F.col("n") - 1)
    return d.agg(
        F.count("*").alias("curves"), F.count(F.when(held, 1)).alias("with_landmark"), F.count(F.when(~held, 1)).alias("without_landmark"),
        F.round(F.avg(F.when(held, F.col("at") / (F.col("n") - 1))), 6).alias("mean_place"),
    )


for _name in ("dropoff_smoothed", "lift_ends", "propulsion_split", "velocity_anchors"):
    ORACLES[_name] = whole_sql(ORACLES[_name])
