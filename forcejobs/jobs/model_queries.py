"""Registered queries on phase models, windows, landing shape and further quantities, each with the SQL of the same answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cols as c
from ..functions import traces as T
from ..functions.scans import integrated
from ..operators import landmarks as L
from ..operators import phases as P
from ..operators import quantities as Q
from .phase_queries import TOPS, ZERO
from .trial_queries import BASE, RESULTS_SQL, answerable, moving, placed, results_frame, rounded, sql_rounded, whole, whole_sql

G = L.GRAVITY
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


VM = """, vx AS (SELECT trial_id, min(v) AS lv, max(v) AS hv FROM k WHERE onset < takeoff AND idx BETWEEN onset AND takeoff - 1 GROUP BY trial_id),
vb AS (SELECT trial_id, min(idx) FILTER (v = lv) AS vmin, min(idx) FILTER (v = hv) AS vmax FROM k JOIN vx USING (trial_id) WHERE idx BETWEEN onset AND takeoff - 1 GROUP BY trial_id)
"""


@query(
    "phase_models",
    BASE
    + TOPS
    + ZERO
    + """, sd AS (SELECT trial_id, min(idx) AS dep FROM m JOIN tp USING (trial_id) WHERE idx >= onset AND idx < top AND f < w GROUP BY trial_id),
sl AS (SELECT trial_id, min(f) AS lf FROM m JOIN sd USING (trial_id) JOIN tp USING (trial_id) WHERE idx >= dep AND idx < top GROUP BY trial_id),
sm AS (SELECT trial_id, min(idx) AS low FROM m JOIN sd USING (trial_id) JOIN tp USING (trial_id) JOIN sl USING (trial_id) WHERE idx >= dep AND idx < top AND f = lf GROUP BY trial_id),
se AS (SELECT trial_id, max(idx) AS back FROM m JOIN sm USING (trial_id) JOIN tp USING (trial_id) WHERE idx BETWEEN low AND top AND f <= w GROUP BY trial_id),
un AS (SELECT trial_id, min(idx) AS unloading FROM m WHERE idx >= onset AND idx < takeoff AND f < w * 0.975e0 GROUP BY trial_id),
ul AS (SELECT trial_id, min(f) AS lf FROM m JOIN un USING (trial_id) JOIN tp USING (trial_id) WHERE idx >= unloading AND idx < top GROUP BY trial_id),
um AS (SELECT trial_id, min(idx) AS least FROM m JOIN un USING (trial_id) JOIN tp USING (trial_id) JOIN ul USING (trial_id) WHERE idx >= unloading AND idx < top AND f = lf GROUP BY trial_id),
wl AS (SELECT trial_id, min(v) AS lv FROM k JOIN um USING (trial_id) WHERE idx >= least AND idx < takeoff GROUP BY trial_id),
wm AS (SELECT trial_id, min(idx) AS slowest FROM k JOIN um USING (trial_id) JOIN wl USING (trial_id) WHERE idx >= least AND idx < takeoff AND v = lv GROUP BY trial_id),
wz AS (SELECT trial_id, min(idx) + 1 AS rising FROM nx JOIN wm USING (trial_id) WHERE idx >= slowest AND idx < takeoff - 1 AND v <= 0 AND nv > 0 GROUP BY trial_id),
ag AS (SELECT trial_id, min(idx) AS driven FROM m JOIN zv USING (trial_id) WHERE idx >= zero AND idx < takeoff AND f >= 0 GROUP BY trial_id)
SELECT lm.trial_id, CASE WHEN back < top THEN dep END AS single_start, CASE WHEN back < top THEN back END AS single_end,
  CASE WHEN rising IS NOT NULL THEN unloading END AS split_unloading, CASE WHEN rising IS NOT NULL THEN least END AS split_force_minimum, CASE WHEN rising IS NOT NULL THEN slowest END AS split_velocity_minimum,
  rising AS split_positive_velocity, CASE WHEN rising IS NOT NULL THEN lm.takeoff END AS split_takeoff, zv.zero AS upward_start, lm.onset + 20 AS epoch_end, driven AS acceleration_start
FROM lm LEFT JOIN sd USING (trial_id) LEFT JOIN se USING (trial_id) LEFT JOIN tp USING (trial_id) LEFT JOIN un USING (trial_id) LEFT JOIN um USING (trial_id) LEFT JOIN wm USING (trial_id) LEFT JOIN wz USING (trial_id) LEFT JOIN zv USING (trial_id) LEFT JOIN ag USING (trial_id)
WHERE lm.onset < lm.takeoff""",
)
@whole
def phase_models(spark, sf_dir):
    """Boundaries of each phase model: one unweighting phase, the five-part split, downward and upward, a fixed epoch.

    A model is placed whole or not at all. acceleration_start is the first sample of the way up without a fall freer than -g.
    """
    v = F.col("velocity")
    d = moving(spark, sf_dir).transform(answerable)
    d = d.withColumns({"top": A.argmax(c.force, c.onset, c.takeoff), "zero": P.velocity_crossing(v, c.onset, c.takeoff)})
    d = d.withColumns({"dep": T.find(c.force, "<", c.weight, c.onset, F.col("top")), "un": T.find(c.force, "<", 0.975 * c.weight, c.onset, c.takeoff)})
    d = d.withColumns({"back": P.rising_crossing(c.force, c.weight, F.col("dep"), F.col("top")), "least": A.argmin(c.force, F.col("un"), F.col("top"))})
    d = d.withColumn("slowest", A.argmin(v, F.col("least"), c.takeoff))
    d = d.withColumn("rising", P.velocity_crossing(v, F.col("slowest"), c.takeoff))
    whole = lambda x: F.when(F.col("rising").isNotNull(), x)
    return d.select(
        "trial_id",
        "code",
        F.when(F.col("back").isNotNull(), F.col("dep")).alias("single_start"),
        F.col("back").alias("single_end"),
        whole(F.col("un")).alias("split_unloading"),
        whole(F.col("least")).alias("split_force_minimum"),
        whole(F.col("slowest")).alias("split_velocity_minimum"),
        F.col("rising").alias("split_positive_velocity"),
        whole(c.takeoff).alias("split_takeoff"),
        F.col("zero").alias("upward_start"),
        (c.onset + 20).alias("epoch_end"),
        T.find(c.force, ">=", 0.0, F.col("zero"), c.takeoff).alias("acceleration_start"),
    )


@query(
    "placed_regions",
    BASE
    + TOPS
    + ZERO
    + VM
    + """, pr AS (SELECT trial_id, 'onset_to_braking_start' AS phase, onset AS start, vmin AS stop FROM lm JOIN vb USING (trial_id)
 UNION ALL SELECT trial_id, 'braking_start_to_propulsion_start', vmin, zero FROM vb LEFT JOIN zv USING (trial_id)
 UNION ALL SELECT trial_id, 'propulsion_start_to_propulsion_end', zero, vmax FROM vb LEFT JOIN zv USING (trial_id))
SELECT trial_id, phase, start, stop, round(start / 100e0, 6) AS start_seconds, round(stop / 100e0, 6) AS stop_seconds FROM pr WHERE start IS NOT NULL AND stop > start""",
)
def placed_regions(spark, sf_dir):
    """The phases whose two ends were placed in order, a row each."""
    v = F.col("velocity")
    d = moving(spark, sf_dir).where(c.ordered)
    d = d.withColumns({"a": A.argmin(v, c.onset, c.takeoff), "b": P.velocity_crossing(v, c.onset, c.takeoff), "z": A.argmax(v, c.onset, c.takeoff)})
    row = lambda name, x, y: F.struct(F.lit(name).alias("phase"), x.alias("start"), y.alias("stop"))
    regions = F.array(
        row("onset_to_braking_start", c.onset, F.col("a")),
        row("braking_start_to_propulsion_start", F.col("a"), F.col("b")),
        row("propulsion_start_to_propulsion_end", F.col("b"), F.col("z")),
    )
    d = d.select("trial_id", c.dt.alias("dt"), F.inline(regions)).where("stop > start")
    return d.select("trial_id", "phase", "start", "stop", *rounded(start_seconds=F.col("start") * F.col("dt"), stop_seconds=F.col("stop") * F.col("dt")))


@query(
    "stated_windows",
    BASE
    + TOPS
    + ZERO
    + VM
    + """, wn AS (SELECT trial_id, 'takeoff_detected' AS name, 0 AS start, takeoff + 1 AS stop, false AS clipped FROM lm WHERE takeoff IS NOT NULL
 UNION ALL SELECT trial_id, 'stated', 50, 150, false FROM lm
 UNION ALL SELECT trial_id, 'propulsion', zero, vmax, false FROM vb JOIN zv USING (trial_id) WHERE vmax > zero
 UNION ALL SELECT trial_id, 'fixed_duration', onset, least(onset + 200, n), onset + 200 > n FROM lm WHERE onset IS NOT NULL)
SELECT trial_id, name, start, stop, clipped, round(max(f), 6) AS peak FROM wn JOIN s USING (trial_id) WHERE idx >= start AND idx < stop GROUP BY ALL""",
)
def stated_windows(spark, sf_dir):
    """Analysis windows that are detected, stated, named by a phase or of fixed length (clipped at the end), and the peak in each."""
    v = F.col("velocity")
    d = moving(spark, sf_dir)
    d = d.withColumns({"b": P.velocity_crossing(v, c.onset, c.takeoff), "z": A.argmax(v, c.onset, c.takeoff)})
    n = F.size("force")
    row = lambda name, x, y, cut: F.struct(F.lit(name).alias("name"), x.cast("int").alias("start"), y.cast("int").alias("stop"), cut.alias("clipped"))
    windows = F.array(
        row("takeoff_detected", F.lit(0), c.takeoff + 1, F.lit(False)),
        row("stated", F.lit(50), F.lit(150), F.lit(False)),
        row("propulsion", F.when(c.ordered, F.col("b")), F.col("z"), F.lit(False)),
        row("fixed_duration", c.onset, F.least(c.onset + 200, n), c.onset + 200 > n),
    )
    peak = lambda w: F.array_max(A.between(c.force, w["start"], w["stop"]))
    kept = F.filter(windows, lambda w: w["start"].isNotNull() & (w["stop"] > w["start"]))
    rows = F.transform(kept, lambda w: F.struct(w["name"].alias("name"), w["start"].alias("start"), w["stop"].alias("stop"), w["clipped"].alias("clipped"), F.round(peak(w), 6).alias("peak")))
    return d.select("trial_id", F.inline(rows))


@query(
    "takeoff_landing_shape",
    BASE
    + """, lw AS (SELECT trial_id, idx, f, w, idx - row_number() OVER (PARTITION BY trial_id ORDER BY idx) AS grp FROM m WHERE f < 20),
rw AS (SELECT trial_id, any_value(w) AS w, min(idx) AS a, max(idx) + 1 AS b FROM lw GROUP BY trial_id, grp),
gp AS (SELECT *, lag(b) OVER (PARTITION BY trial_id ORDER BY a) AS pb FROM rw),
gm AS (SELECT gp.trial_id, gp.a, max(s.f) AS hi FROM gp JOIN s ON s.trial_id = gp.trial_id AND s.idx >= pb AND s.idx < gp.a GROUP BY ALL),
gs AS (SELECT gp.*, sum(CASE WHEN pb IS NOT NULL AND gp.a - pb <= 2 AND hi <= 0.1e0 * w THEN 0 ELSE 1 END) OVER (PARTITION BY gp.trial_id ORDER BY gp.a) AS g FROM gp LEFT JOIN gm USING (trial_id, a)),
rn AS (SELECT trial_id, any_value(w) AS w, min(a) AS a, max(b) AS b FROM gs GROUP BY trial_id, g),
sg AS (SELECT rn.trial_id, rn.a, rn.w, s.idx - rn.b AS o, s.f AS x, rn.b FROM rn JOIN s ON s.trial_id = rn.trial_id AND s.idx >= rn.b AND s.idx < rn.b + 60),
sz AS (SELECT *, count(*) OVER q AS n, (x + coalesce(lag(x) OVER z, 0) + coalesce(lead(x) OVER z, 0)) / 3e0 AS sm, lead(x, 3) OVER z AS x3 FROM sg WINDOW q AS (PARTITION BY trial_id, a), z AS (PARTITION BY trial_id, a ORDER BY o)),
sl AS (SELECT *, lead(sm) OVER z - sm AS sl FROM sz WINDOW z AS (PARTITION BY trial_id, a ORDER BY o)),
fl AS (SELECT *, max(sl) OVER z AS ms, count(sl) OVER z AS cs FROM sl WINDOW z AS (PARTITION BY trial_id, a ORDER BY o ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
tf AS (SELECT trial_id, a, coalesce(min(o) FILTER (ms <= 0 AND cs = 3 AND o >= 3 AND o < n - 1 - 3), arg_max(o, sm - o * 1e-9)) AS top, any_value(n) AS n, any_value(w) AS w FROM fl GROUP BY trial_id, a),
ok AS (SELECT trial_id, a, top, max(sl) FILTER (o < top) AS up, max(x) FILTER (o <= top) AS pk, max(x) FILTER (o = 0) AS x0, max((x3 - x) / 0.03e0) FILTER (o < top) AS steep, any_value(tf.w) AS w, any_value(tf.n) AS n FROM fl JOIN tf USING (trial_id, a) GROUP BY trial_id, a, top),
la AS (SELECT trial_id, min(a) AS takeoff, count(*)::INT AS landings FROM ok WHERE n >= 4 AND top >= 3 AND up > 0 AND pk - x0 >= 0.2e0 * w AND steep / w >= 20 AND pk / w >= 0.5e0 GROUP BY trial_id)
SELECT ep.trial_id, la.takeoff, coalesce(landings, 0) AS landings FROM ep LEFT JOIN la USING (trial_id)""",
)
def takeoff_landing_shape(spark, sf_dir):
    """Takeoff by the shape of the rise that ends a low-force run, and how many runs end in a landing."""
    d = placed(spark, sf_dir).withColumn("s", T.landing_shape(c.force, c.weight, F.col("sample_rate_hz")))
    return d.select("trial_id", F.col("s.takeoff").alias("takeoff"), F.col("s.landings").alias("landings"))


@query(
    "power_regressions",
    RESULTS_SQL
    + ", co AS (SELECT * FROM (VALUES "
    + ", ".join(f"('{n}', {a}e0, {u}e0, {b}e0, {k}e0)" for n, (a, u, b, k) in Q.POWER_REGRESSIONS.items())
    + ") AS t(population, a, u, b, k)) SELECT trial_id, population, round(a * height_flight / u + b * system_mass + co.k, 6) AS watts FROM q CROSS JOIN co WHERE height_flight IS NOT NULL",
)
def power_regressions(spark, sf_dir):
    """Peak power from jump height by every published population."""
    d = results_frame(spark, sf_dir).where("height_flight IS NOT NULL")
    watts = lambda a, u, b, k: F.round(a * F.col("height_flight") / u + b * F.col("system_mass") + k, 6)
    rows = [F.struct(F.lit(n).alias("population"), watts(*x).alias("watts")) for n, x in Q.POWER_REGRESSIONS.items()]
    return d.select("trial_id", F.inline(F.array(*rows)))


@query(
    "further_quantities",
    RESULTS_SQL
    + """, z AS (SELECT *, f * v AS gp, lag(f) OVER y AS pf, lead(f) OVER y AS nf FROM k WHERE onset < takeoff WINDOW y AS (PARTITION BY trial_id ORDER BY idx)),
lp AS (SELECT trial_id, min(gp) AS lp, max(f) FILTER (idx <= takeoff) AS hf FROM z WHERE idx BETWEEN onset AND takeoff GROUP BY trial_id),
l2 AS (SELECT trial_id, min(gp) AS lp FROM z WHERE idx >= onset AND idx < takeoff GROUP BY trial_id),
lt AS (SELECT trial_id, min(idx) AS trough FROM z JOIN l2 USING (trial_id) WHERE idx >= onset AND idx < takeoff AND gp = lp GROUP BY trial_id),
hp AS (SELECT trial_id, max(gp) AS hp FROM z JOIN lt USING (trial_id) WHERE idx > trough AND idx < takeoff GROUP BY trial_id),
ht AS (SELECT trial_id, max(idx) AS peak FROM z JOIN lt USING (trial_id) JOIN hp USING (trial_id) WHERE idx > trough AND idx < takeoff AND gp = hp GROUP BY trial_id),
hh AS (SELECT trial_id, min(idx) AS half FROM z JOIN lp USING (trial_id) WHERE idx BETWEEN onset AND takeoff AND f >= 0.5e0 * hf GROUP BY trial_id),
hi AS (SELECT trial_id, sum(f - w) FILTER (idx BETWEEN onset AND half) - 0.5e0 * (sum(f - w) FILTER (idx = onset) + sum(f - w) FILTER (idx = half)) AS imp, any_value(half) AS half FROM z JOIN hh USING (trial_id) GROUP BY trial_id),
hq AS (SELECT trial_id, min(idx) AS later FROM z JOIN lp USING (trial_id) WHERE idx BETWEEN onset + 20 AND takeoff AND f >= 0.8e0 * hf GROUP BY trial_id),
ip AS (SELECT trial_id, later - 1 + (0.8e0 * hf - pf) / (f - pf) AS pos FROM z JOIN hq USING (trial_id) JOIN lp USING (trial_id) WHERE idx = later AND later > onset + 20),
cd AS (SELECT trial_id, max((nf - pf) / 0.02e0) FILTER (idx = floor(pos)) AS d0, max((nf - pf) / 0.02e0) FILTER (idx = floor(pos) + 1) AS d1, any_value(pos - floor(pos)) AS fr FROM z JOIN ip USING (trial_id) GROUP BY trial_id),
rv AS (SELECT trial_id, max(v) FILTER (idx = takeoff) AS ramp FROM z GROUP BY trial_id),
st AS (SELECT trial_id, nullif(avg(f), 0) AS w2 FROM m WHERE idx >= n - 20 GROUP BY trial_id),
av AS (SELECT trial_id, idx, n, takeoff, sum(CASE WHEN idx > 100 THEN 0.005e0 * ((f - w2) + (pf - w2)) / (w2 / """
    + str(G)
    + """) ELSE 0e0 END) OVER (PARTITION BY trial_id ORDER BY idx) AS av FROM (SELECT *, lag(f) OVER (PARTITION BY trial_id ORDER BY idx) AS pf FROM m) JOIN st USING (trial_id) WHERE onset < takeoff),
am AS (SELECT trial_id, avg(av) FILTER (idx >= n - 20) AS standing, max(av) FILTER (idx = takeoff) AS at_takeoff FROM av WHERE idx >= 100 GROUP BY trial_id)
SELECT trial_id, """
    + sql_rounded(
        rsi_flight="height_flight / time_to_takeoff",
        flight_over_contraction="flight_time / time_to_takeoff",
        rate_trough_to_peak="(hp - l2.lp) / ((peak - trough) / 100e0)",
        impulse_to_half_peak="CASE WHEN half > q.onset THEN 0.01e0 * imp ELSE 0 END",
        rfd_at_share_of_peak="d0 + (d1 - d0) * fr",
        velocity_at_takeoff="ramp",
        arrival_velocity="CASE WHEN q.touchdown IS NOT NULL THEN 0 - standing END",
        height_from_arrival=f"CASE WHEN q.touchdown IS NOT NULL AND at_takeoff - standing > 0 THEN (at_takeoff - standing) ** 2 / (2 * {G}) END",
        mass_scaled_threshold="250e0 * (system_mass / 87.5e0) ** 0.667e0",
    )
    + " FROM q JOIN l2 USING (trial_id) LEFT JOIN hp USING (trial_id) LEFT JOIN lt USING (trial_id) LEFT JOIN ht USING (trial_id) LEFT JOIN hi USING (trial_id) LEFT JOIN cd USING (trial_id) LEFT JOIN rv USING (trial_id) LEFT JOIN am USING (trial_id) WHERE q.onset < q.takeoff",
)
@whole
def further_quantities(spark, sf_dir):
    """Reactive strength by flight time, rate of power from trough to peak, impulse and rate at a share of peak force.

    Also velocity at takeoff by the impulse up to it, and a height whose velocity is put right by the standing after landing
    (the last 20 samples, which give weight too; integration starts at sample 100).
    """
    d = Q.default_quantities(moving(spark, sf_dir)).transform(answerable)
    n, peak = F.size("force"), F.array_max(A.between(c.force, c.onset, c.takeoff + 1))
    d = d.withColumn("power", F.zip_with("force", "velocity", lambda f, v: f * v)).withColumn("hf", peak)
    d = d.withColumns(
        {
            "tp": T.trough_to_peak(F.col("power"), c.onset, c.takeoff),
            "half": T.find(c.force, ">=", 0.5 * F.col("hf"), c.onset, c.takeoff + 1),
            "share": Q.level_crossing(c.force, 0.8 * F.col("hf"), c.onset + 20, c.takeoff),
            "w2": T.level(c.force, n - 20, n)["level"],
        }
    )
    w2 = F.when(c.touchdown.isNotNull() & (F.col("w2") > 0), F.col("w2"))
    d = d.withColumn("av", integrated()(F.transform("force", lambda x: (x - w2) / (w2 / G)), F.lit(100), c.dt))
    d = d.withColumn("standing", A.mean(A.between(F.col("av"), n - 20, n)))
    v0 = A.at(F.col("av"), c.takeoff) - F.col("standing")
    climb = A.at(F.col("power"), F.col("tp.high")) - A.at(F.col("power"), F.col("tp.low"))
    return d.select(
        "trial_id",
        "code",
        *rounded(
            rsi_flight=F.col("height_flight") / F.col("time_to_takeoff"),
            flight_over_contraction=F.col("flight_time") / F.col("time_to_takeoff"),
            rate_trough_to_peak=climb / ((F.col("tp.high") - F.col("tp.low")) * c.dt),
            impulse_to_half_peak=Q.impulse(c.force, c.onset, F.col("half"), c.weight),
            rfd_at_share_of_peak=F.when(F.col("share") > c.onset + 20, Q.centred_derivative(c.force, F.col("share"), c.dt)),
            velocity_at_takeoff=Q.impulse(c.force, c.onset, c.takeoff, c.weight) / (c.weight / G),
            arrival_velocity=F.when(c.touchdown.isNotNull(), 0 - F.col("standing")),
            height_from_arrival=F.when(c.touchdown.isNotNull() & (v0 > 0), v0 * v0 / (2 * G)),
            mass_scaled_threshold=250.0 * F.pow(F.col("system_mass") / 87.5, F.lit(0.667)),
        ),
    )


for _name in ("phase_models", "further_quantities"):
    ORACLES[_name] = whole_sql(ORACLES[_name])
