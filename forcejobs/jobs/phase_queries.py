"""Registered queries on windows, regions and rules that walk back from a peak, each with the SQL of the same answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cols as c
from ..functions import traces as T
from ..operators import landmarks as L
from ..operators import phases as P
from .trial_queries import BASE, answerable, moving, needs, placed, rounded, sql_rounded, whole, whole_sql

G = L.GRAVITY
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query(
    "onset_last_within_band",
    BASE
    + """, hi AS (SELECT trial_id, max(f) AS hf FROM m WHERE idx < takeoff GROUP BY trial_id),
pk AS (SELECT trial_id, min(idx) AS peak FROM m JOIN hi USING (trial_id) WHERE idx < takeoff AND f = hf GROUP BY trial_id),
lo AS (SELECT trial_id, min(f) AS lf FROM m JOIN pk USING (trial_id) WHERE idx < peak GROUP BY trial_id),
bn AS (SELECT trial_id, min(idx) AS bound FROM m JOIN pk USING (trial_id) JOIN lo USING (trial_id) WHERE idx < peak AND f = lf GROUP BY trial_id),
ca AS (SELECT trial_id, max(idx) AS cand FROM m JOIN bn USING (trial_id) WHERE idx <= bound AND sd > 0 AND w - 5 * sd > 0 AND f >= w - 5 * sd GROUP BY trial_id),
pr AS (SELECT trial_id, max(f) AS pf, any_value(w + 5 * sd) AS upper FROM m JOIN ca USING (trial_id) WHERE idx BETWEEN greatest(cand - 50, 0) AND cand GROUP BY trial_id),
pp AS (SELECT trial_id, min(idx) AS pre FROM m JOIN ca USING (trial_id) JOIN pr USING (trial_id) WHERE idx BETWEEN greatest(cand - 50, 0) AND cand AND f = pf AND pf > upper GROUP BY trial_id),
rs AS (SELECT trial_id, max(idx) AS resolved FROM m JOIN pp USING (trial_id) JOIN pr USING (trial_id) WHERE idx <= pre AND f <= upper GROUP BY trial_id)
SELECT lm.trial_id, bound, cand AS candidate, pre AS preload_peak, CASE WHEN cand IS NOT NULL THEN greatest(CASE WHEN pre IS NULL THEN cand ELSE resolved END - 3, 0) END AS onset_back
FROM lm LEFT JOIN bn USING (trial_id) LEFT JOIN ca USING (trial_id) LEFT JOIN pp USING (trial_id) LEFT JOIN rs USING (trial_id)""",
)
def onset_last_within_band(spark, sf_dir):
    """The last sample inside the noise band before the force minimum; with a pre-load, the walk starts at its peak."""
    d, sd = placed(spark, sf_dir), F.col("weight_sd")
    d = d.withColumn("bound", A.argmin(c.force, 0, A.argmax(c.force, 0, c.takeoff)))
    lower = F.when((sd > 0) & (c.weight - 5 * sd > 0), c.weight - 5 * sd)
    d = d.withColumn("candidate", T.find(c.force, ">=", lower, 0, F.col("bound") + 1, last=True))
    d = d.withColumn("pre", A.argmax(c.force, F.greatest(F.col("candidate") - 50, F.lit(0)), F.col("candidate") + 1))
    d = d.withColumn("preload_peak", F.when(A.at(c.force, F.col("pre")) > c.weight + 5 * sd, F.col("pre")))
    walked = T.find(c.force, "<=", c.weight + 5 * sd, 0, F.col("preload_peak") + 1, last=True)
    at = F.when(F.col("preload_peak").isNull(), F.col("candidate")).otherwise(walked)
    return d.select("trial_id", "bound", "candidate", "preload_peak", F.when(F.col("candidate").isNotNull(), F.greatest(at - 3, F.lit(0))).alias("onset_back"))


TOPS = """, hi AS (SELECT trial_id, max(f) AS hf FROM m WHERE onset < takeoff AND idx BETWEEN onset AND takeoff - 1 GROUP BY trial_id),
tp AS (SELECT trial_id, min(idx) AS top FROM m JOIN hi USING (trial_id) WHERE idx BETWEEN onset AND takeoff - 1 AND f = hf GROUP BY trial_id),
lo AS (SELECT trial_id, min(f) AS lf FROM m JOIN tp USING (trial_id) WHERE idx >= onset AND idx < top GROUP BY trial_id),
fm AS (SELECT trial_id, min(idx) AS fmin FROM m JOIN tp USING (trial_id) JOIN lo USING (trial_id) WHERE idx >= onset AND idx < top AND f = lf GROUP BY trial_id)
"""


@query(
    "analysis_windows",
    BASE
    + TOPS
    + """, c2 AS (SELECT trial_id, idx, f, onset, takeoff, w, lead(f, 2) OVER (PARTITION BY trial_id ORDER BY idx) - f AS rise FROM m WHERE onset < takeoff),
st AS (SELECT trial_id, max(rise) AS mr FROM c2 WHERE idx BETWEEN onset AND takeoff - 2 GROUP BY trial_id),
sx AS (SELECT trial_id, min(idx) AS steep FROM c2 JOIN st USING (trial_id) WHERE idx BETWEEN onset AND takeoff - 2 AND rise = mr GROUP BY trial_id),
rm AS (SELECT trial_id, idx, f, max(f) OVER (PARTITION BY trial_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM c2 JOIN sx USING (trial_id) WHERE idx >= steep),
dp AS (SELECT trial_id, min(idx) AS dropoff FROM rm WHERE top IS NOT NULL AND f <= top AND f < 0.95e0 * top GROUP BY trial_id),
ri AS (SELECT trial_id, max(idx) AS r FROM m JOIN fm USING (trial_id) JOIN tp USING (trial_id) WHERE idx BETWEEN fmin AND top AND f <= w GROUP BY trial_id),
fa AS (SELECT trial_id, min(idx) AS fall FROM m JOIN tp USING (trial_id) WHERE idx BETWEEN top AND takeoff AND f <= w GROUP BY trial_id),
hf AS (SELECT trial_id, min(idx) AS half FROM m JOIN hi USING (trial_id) WHERE idx BETWEEN onset AND takeoff AND f >= 0.5e0 * hf GROUP BY trial_id)
SELECT trial_id, steep AS steepest, dropoff, CASE WHEN r < top THEN r END AS positive_start, CASE WHEN fall > top THEN fall END AS positive_end, half AS half_peak FROM sx LEFT JOIN dp USING (trial_id) LEFT JOIN tp USING (trial_id) LEFT JOIN ri USING (trial_id) LEFT JOIN fa USING (trial_id) LEFT JOIN hf USING (trial_id)""",
)
@whole
def analysis_windows(spark, sf_dir):
    """Ends of the analysis window: drop-off from the running maximum, positive net impulse, half of peak force."""
    d = placed(spark, sf_dir).transform(answerable)
    d = d.withColumns({"steepest": T.steepest(c.force, 2, c.onset, c.takeoff)["start"], "top": A.argmax(c.force, c.onset, c.takeoff)})
    half = T.find(c.force, ">=", 0.5 * A.at(c.force, F.col("top")), c.onset, c.takeoff + 1)
    return d.select(
        "trial_id",
        "code",
        "steepest",
        P.dropoff(c.force, F.col("steepest")).alias("dropoff"),
        P.rising_crossing(c.force, c.weight, c.onset, F.col("top")).alias("positive_start"),
        P.falling_crossing(c.force, c.weight, F.col("top"), c.takeoff).alias("positive_end"),
        half.alias("half_peak"),
    )


@query(
    "transient_peaks",
    BASE
    + """, n AS (SELECT trial_id, idx, f, onset, takeoff, lag(f) OVER y AS pf, lead(f) OVER y AS nf FROM m WHERE onset < takeoff WINDOW y AS (PARTITION BY trial_id ORDER BY idx))
SELECT trial_id, count(*) FILTER (idx > onset AND idx < takeoff - 1 AND f > pf AND nf <= f) AS peaks, count(*) FILTER (idx > onset AND idx < takeoff - 1 AND f > pf AND nf <= f) > 3 AS fired FROM n GROUP BY trial_id""",
)
@whole
def transient_peaks(spark, sf_dir):
    """Local peaks between onset and takeoff, and whether there are too many."""
    d = placed(spark, sf_dir).transform(answerable)
    return d.select("trial_id", "code", T.peaks(c.force, c.onset, c.takeoff).alias("peaks")).withColumn("fired", F.col("peaks") > 3)


@query(
    "sticking_region",
    BASE
    + """, n AS (SELECT trial_id, idx, f, lag(f) OVER y AS pf, lead(f) OVER y AS nf FROM s WINDOW y AS (PARTITION BY trial_id ORDER BY idx)),
a AS (SELECT trial_id, min(idx) AS start FROM n WHERE idx BETWEEN 101 AND 118 AND f > pf AND NOT nf > f GROUP BY trial_id),
b AS (SELECT trial_id, min(idx) AS stop FROM n JOIN a USING (trial_id) WHERE idx BETWEEN start + 1 AND 118 AND f < pf AND NOT nf < f GROUP BY trial_id)
SELECT o.k AS trial_id, CASE WHEN stop IS NOT NULL THEN start END AS start, stop FROM o LEFT JOIN a ON a.trial_id = o.k LEFT JOIN b ON b.trial_id = o.k""",
)
def sticking_region(spark, sf_dir):
    """First local maximum and the next local minimum of a series in a stated ascent."""
    from ..sources.trials import trials

    return trials(spark, sf_dir).select("trial_id", F.inline(F.array(P.sticking_region(c.force, 100, 119))))


ZERO = """, nx AS (SELECT *, lead(v) OVER (PARTITION BY trial_id ORDER BY idx) AS nv FROM k WHERE onset < takeoff),
lv AS (SELECT trial_id, min(v) AS lv FROM nx WHERE idx BETWEEN onset AND takeoff - 1 GROUP BY trial_id),
vm AS (SELECT trial_id, min(idx) AS vmin FROM nx JOIN lv USING (trial_id) WHERE idx BETWEEN onset AND takeoff - 1 AND v = lv GROUP BY trial_id),
zv AS (SELECT trial_id, min(idx) + 1 AS zero FROM nx JOIN vm USING (trial_id) WHERE idx >= vmin AND idx < takeoff - 1 AND v <= 0 AND nv > 0 GROUP BY trial_id),
e AS (SELECT trial_id, any_value(zero) AS zero, any_value(takeoff) AS takeoff, any_value(onset) AS onset, any_value(top) AS top, max(v) FILTER (idx = takeoff - 1) AS vt, max(d) FILTER (idx = takeoff - 1) - max(d) FILTER (idx = zero) AS rise,
  max(f) FILTER (idx = top) AS ft, max(f) FILTER (idx = zero) AS fz, avg(f) FILTER (idx BETWEEN zero AND takeoff - 1) AS mf,
  max(v - (idx - onset) / (takeoff - 1 - onset) * 0.1e0) FILTER (idx BETWEEN onset AND takeoff - 1) AS leant FROM k JOIN zv USING (trial_id) JOIN tp USING (trial_id) GROUP BY trial_id)
"""


@query(
    "push_off",
    BASE
    + TOPS
    + ZERO
    + "SELECT trial_id, "
    + sql_rounded(
        push_off_index=f"CASE WHEN rise > 0 AND vt > 0 THEN vt ** 2 / (2 * {G}) / (rise / (vt / 2)) END",
        secant_rate="CASE WHEN top <> zero THEN (ft - fz) / ((top - zero) * 0.01e0) END",
        mean_force_over_duration="mf / ((takeoff - 1 - zero) * 0.01e0)",
        anchored_peak="leant",
    )
    + " FROM e",
)
@whole
def push_off(spark, sf_dir):
    """Push-off index, rates over the propulsion phase, and peak velocity less a line between two anchors."""
    v, disp = F.col("velocity"), F.col("displacement")
    d = moving(spark, sf_dir).transform(answerable)
    d = d.withColumns({"zero": P.velocity_crossing(v, c.onset, c.takeoff), "top": A.argmax(c.force, c.onset, c.takeoff)}).transform(needs("zero"))
    zero, top = F.col("zero"), F.col("top")
    vt, rise = A.at(v, c.last), A.at(disp, c.last) - A.at(disp, zero)
    leant = F.transform(v, lambda x, i: x - (i - c.onset) / (c.last - c.onset) * 0.1)
    return d.select(
        "trial_id",
        "code",
        *rounded(
            push_off_index=F.when((rise > 0) & (vt > 0), vt * vt / (2 * G) / (rise / (vt / 2))),
            secant_rate=F.when(top != zero, F.try_divide(A.at(c.force, top) - A.at(c.force, zero), (top - zero) * c.dt)),
            mean_force_over_duration=A.mean(A.between(c.force, zero, c.takeoff)) / ((c.last - zero) * c.dt),
            anchored_peak=F.array_max(A.between(leant, c.onset, c.takeoff)),
        ),
    )




@query(
    "lift_phases",
    BASE
    + TOPS
    + ZERO
    + """, db AS (SELECT trial_id, min(idx) AS fall FROM m JOIN tp USING (trial_id) WHERE idx BETWEEN top AND takeoff AND f <= w - 10 GROUP BY trial_id),
dm AS (SELECT trial_id, max(d) AS dm FROM k WHERE onset < takeoff AND idx >= onset AND idx < takeoff GROUP BY trial_id),
dx AS (SELECT trial_id, min(idx) AS highest FROM k JOIN dm USING (trial_id) WHERE idx >= onset AND idx < takeoff AND d = dm GROUP BY trial_id)
SELECT trial_id, zero AS lift_start, CASE WHEN fall > e.top THEN fall END AS lift_end_net_force, highest AS lift_end_displacement FROM e LEFT JOIN db USING (trial_id) LEFT JOIN dx USING (trial_id)""",
)
@whole
def lift_phases(spark, sf_dir):
    """A lift from the velocity's zero crossing to where net force is gone (10 N of deadband), or to the highest place."""
    d = moving(spark, sf_dir).transform(answerable)
    d = d.withColumns({"lift_start": P.velocity_crossing(F.col("velocity"), c.onset, c.takeoff), "top": A.argmax(c.force, c.onset, c.takeoff)}).transform(needs("lift_start"))
    return d.select(
        "trial_id",
        "code",
        "lift_start",
        P.falling_crossing(c.force, c.weight - 10, F.col("top"), c.takeoff).alias("lift_end_net_force"),
        A.argmax(F.col("displacement"), c.onset, c.takeoff).alias("lift_end_displacement"),
    )


for _name in ("analysis_windows", "transient_peaks", "push_off", "lift_phases"):
    ORACLES[_name] = whole_sql(ORACLES[_name])
