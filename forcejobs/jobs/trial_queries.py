"""Registered queries on single trials, each with the SQL of the same answer."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cols as c
from ..functions import scans
from ..functions import traces as T
from ..operators import landmarks as L
from ..operators import quantities as Q
from ..sources.trials import SAMPLES_CTE, trials

G = L.GRAVITY

#: s: samples; lm: trial-level landmarks of the default chain (see operators.landmarks.place).
BASE = f"""
WITH {SAMPLES_CTE},
ep AS (SELECT trial_id, any_value(subject) AS subject, any_value(occasion) AS occasion, count(*) AS n,
              avg(f) FILTER (idx < 100) AS w, stddev_samp(f) FILTER (idx < 100) AS sd FROM s GROUP BY trial_id),
tk AS (SELECT trial_id, min(idx) AS takeoff FROM
         (SELECT trial_id, idx, max(f) OVER x AS hi, count(*) OVER x AS c FROM s
          WINDOW x AS (PARTITION BY trial_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))
       WHERE idx >= 100 AND hi < 20 AND c = 3 GROUP BY trial_id),
oq AS (SELECT s.trial_id, idx, max(f) OVER x AS hi, min(f) OVER x AS lo, count(*) OVER x AS c, count(*) FILTER (f < w - 5 * sd OR f > w + 5 * sd) OVER x AS outs, w, sd, takeoff
       FROM s JOIN ep USING (trial_id) LEFT JOIN tk USING (trial_id)
       WINDOW x AS (PARTITION BY s.trial_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
onx AS (SELECT trial_id, greatest(min(idx) - 3, 0) AS onset FROM oq
        WHERE idx >= 100 AND idx < takeoff AND c = 3 AND sd > 0 AND w - 5 * sd > 0 AND hi < w - 5 * sd GROUP BY trial_id),
cf AS (SELECT trial_id, min(idx) AS confirmed FROM s JOIN ep USING (trial_id) JOIN tk USING (trial_id)
       WHERE idx >= takeoff AND f > 20 AND f >= w GROUP BY trial_id),
td AS (SELECT trial_id, max(idx) + 1 AS touchdown FROM s JOIN tk USING (trial_id) JOIN cf USING (trial_id)
       WHERE idx >= takeoff AND idx < confirmed AND f <= 20 GROUP BY trial_id),
lm AS (SELECT ep.*, takeoff, onset, touchdown FROM ep LEFT JOIN tk USING (trial_id) LEFT JOIN onx USING (trial_id) LEFT JOIN td USING (trial_id)),
m AS (SELECT s.trial_id, s.idx, s.f, lm.n, w, sd, onset, takeoff, touchdown FROM s JOIN lm USING (trial_id)),
va AS (SELECT *, CASE WHEN idx > onset THEN 0.005e0 * ((f - w) + lag(f - w) OVER (PARTITION BY trial_id ORDER BY idx)) / (w / {G}) ELSE 0e0 END AS dv FROM m),
vv AS (SELECT *, sum(dv) OVER (PARTITION BY trial_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS v FROM va WHERE onset IS NOT NULL),
dd AS (SELECT *, CASE WHEN idx > onset THEN 0.005e0 * (v + lag(v) OVER (PARTITION BY trial_id ORDER BY idx)) ELSE 0e0 END AS dx FROM vv),
k AS (SELECT *, sum(dx) OVER (PARTITION BY trial_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS d, (f - w) * v AS p FROM dd)
"""


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.place(trials(spark, sf_dir))


def moving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.place(trials(spark, sf_dir), moving=True)


def answerable(d: DataFrame) -> DataFrame:
    """Adds code, why a movement has no answer (null where it has one), and blanks onset and takeoff where it has none."""
    code = F.when(c.takeoff.isNull(), "no_takeoff").when(c.onset.isNull() & (F.col("weight_sd") <= 0), "collapsed_band")
    code = code.when(c.onset.isNull(), "no_onset").when(~c.ordered, "not_ordered")
    d = d.withColumn("code", code)
    return d.withColumns({x: F.when(F.col("code").isNull(), F.col(x)) for x in ("onset", "takeoff")})


def needs(column: str | Column):
    """For transform(): a trial without the column gets the code no_answer, unless it has another."""
    found = F.col(column) if isinstance(column, str) else column
    return lambda d: d.withColumn("code", F.coalesce("code", F.when(found.isNull(), "no_answer")))


def whole(f):
    """A query of one row for every trial: where its code tells that there is no answer, every other column is null."""

    @functools.wraps(f)
    def run(spark, sf_dir):
        d = f(spark, sf_dir)
        return d.select(*[x if x in ("trial_id", "code") else F.when(F.col("code").isNull(), F.col(x)).alias(x) for x in d.columns])

    return run


def whole_sql(sql: str) -> str:
    """The same for the checking SQL: trials that it leaves out come back with a code."""
    code = "CASE WHEN lm.takeoff IS NULL THEN 'no_takeoff' WHEN lm.onset IS NULL AND lm.sd <= 0 THEN 'collapsed_band' WHEN lm.onset IS NULL THEN 'no_onset' WHEN NOT lm.onset < lm.takeoff THEN 'not_ordered' WHEN z.trial_id IS NULL THEN 'no_answer' END"
    return f"{BASE} SELECT lm.trial_id, {code} AS code, z.* EXCLUDE (trial_id) FROM lm LEFT JOIN ({sql}) z ON z.trial_id = lm.trial_id"


def rounded(**cols: Column) -> list[Column]:
    return [F.round(c, 6).alias(name) for name, c in cols.items()]


def sql_rounded(**cols: str) -> str:
    return ", ".join(f"round({c}, 6) AS {name}" for name, c in cols.items())


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


RESULTS_SQL = (
    BASE
    + f""", r AS (
SELECT lm.*, w / {G} AS system_mass, onset / 100e0 AS onset_time, takeoff / 100e0 AS takeoff_time,
  CASE WHEN onset < takeoff THEN (takeoff - onset) / 100e0 END AS time_to_takeoff, (touchdown - takeoff) / 100e0 AS flight_time,
  CASE WHEN onset < takeoff THEN (SELECT k.v FROM k WHERE k.trial_id = lm.trial_id AND k.idx = lm.takeoff - 1) END AS takeoff_velocity FROM lm),
q AS (SELECT *, takeoff_velocity * system_mass AS net_impulse, takeoff_velocity ** 2 / (2 * {G}) AS height_takeoff, {G} * flight_time ** 2 / 8 AS height_flight,
  CASE WHEN time_to_takeoff > 0 THEN takeoff_velocity ** 2 / (2 * {G}) / time_to_takeoff END AS rsi_modified FROM r)
"""
)
NAMES = ["system_mass", "onset_time", "takeoff_time", "time_to_takeoff", "flight_time", "takeoff_velocity", "net_impulse", "height_takeoff", "height_flight", "rsi_modified"]


def results_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.default_quantities(L.place(trials(spark, sf_dir), pushed=True))


@query(
    "results",
    RESULTS_SQL + "SELECT trial_id, subject, onset, takeoff, touchdown, round(w, 6) AS weight, round(sd, 6) AS weight_sd, " + sql_rounded(**{n: n for n in NAMES}) + " FROM q",
)
def results(spark, sf_dir):
    """Default chain and the eleven quantities that are always computed."""
    d = results_frame(spark, sf_dir)
    return d.select("trial_id", "subject", "onset", "takeoff", "touchdown", *rounded(weight=c.weight, weight_sd=F.col("weight_sd"), **{n: F.col(n) for n in NAMES}))


@query(
    "weighing_fixed_window",
    f"WITH {SAMPLES_CTE} SELECT trial_id, round(avg(f) FILTER (idx < 100), 6) AS mean_weight, round(median(f) FILTER (idx < 100), 6) AS median_weight, "
    "round(stddev_samp(f) FILTER (idx < 100), 6) AS sd_sample, round(stddev_pop(f) FILTER (idx < 100), 6) AS sd_population, "
    "round(avg(f) FILTER (idx BETWEEN 20 AND 69), 6) AS placed_weight, round(stddev_samp(f) FILTER (idx BETWEEN 20 AND 69), 6) AS placed_sd FROM s GROUP BY trial_id",
)
def weighing_fixed_window(spark, sf_dir):
    """First second of standing, mean or median, sample or population deviation; and a stated start."""
    d = trials(spark, sf_dir)
    a, p = A.between(c.force, 0, 100), A.between(c.force, 20, 70)
    return d.select(
        "trial_id",
        *rounded(mean_weight=A.mean(a), median_weight=A.median(a), sd_sample=A.deviation(a), sd_population=A.deviation(a, 0), placed_weight=A.mean(p), placed_sd=A.deviation(p)),
    )


@query(
    "weighing_lowest_variance",
    f"""WITH {SAMPLES_CTE}, md AS (SELECT trial_id, median(f) AS md FROM s GROUP BY trial_id),
x AS (SELECT s.trial_id, idx, round(var_pop(f) OVER z, 9) AS v, min(f) OVER z <= 0.025e0 * md AS bad, count(*) OVER z AS c
      FROM s JOIN md USING (trial_id) WINDOW z AS (PARTITION BY s.trial_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
b AS (SELECT trial_id, count(*) FILTER (NOT bad) AS candidates, count(*) FILTER (bad) AS rejected,
             arg_min(idx, v * 1000e0 + idx * 1e-12) FILTER (NOT bad) AS start FROM x WHERE c = 50 GROUP BY trial_id)
SELECT trial_id, start, candidates, rejected, round(avg(f), 6) AS weight FROM b JOIN s USING (trial_id) WHERE s.idx BETWEEN start AND start + 49 GROUP BY ALL""",
)
def weighing_lowest_variance(spark, sf_dir):
    """The steadiest half second of the trial that does not hold an unloaded sample."""
    d = trials(spark, sf_dir).withColumn("b", scans.steadiest_window(50)("force"))
    start = F.col("b.start")
    return d.select("trial_id", start.alias("start"), F.col("b.candidates").cast("long").alias("candidates"), F.col("b.rejected").cast("long").alias("rejected"), *rounded(weight=A.mean(A.between(c.force, start, start + 50))))


@query(
    "onset_rules",
    BASE
    + """, tr AS (SELECT trial_id, idx, f, avg(f) OVER z AS mu, stddev_samp(f) OVER z AS dev FROM s WINDOW z AS (PARTITION BY trial_id ORDER BY idx ROWS BETWEEN 100 PRECEDING AND CURRENT ROW)),
bt AS (SELECT trial_id, min(idx) AS bottom FROM (SELECT trial_id, idx, f, min(f) OVER (PARTITION BY trial_id) AS lo FROM s) WHERE f = lo GROUP BY trial_id),
lc AS (SELECT trial_id, max(idx) AS crossed FROM tr JOIN bt USING (trial_id) WHERE bottom > 101 AND idx BETWEEN 101 AND bottom - 1 AND f < mu - 5 * dev - 1e-6 GROUP BY trial_id),
ad AS (SELECT trial_id, max(idx) + 1 AS adaptive FROM tr JOIN lc USING (trial_id) WHERE idx < crossed AND (idx <= 100 OR NOT f < mu - 5 * dev - 1e-6) GROUP BY trial_id),
fd AS (SELECT trial_id, least(max(idx) + 1, least(any_value(takeoff) + 1, any_value(n)) - 1) AS departure FROM m
       WHERE idx <= takeoff AND f >= w - 5 * sd AND sd > 0 GROUP BY trial_id),
g AS (SELECT trial_id,
  min(idx) FILTER (sd > 0 AND outs = 3) AS a1,
  min(idx) FILTER (sd <= 0 AND hi < 0.975e0 * w) AS a2,
  min(idx) FILTER (hi < 0.975e0 * w) AS b, min(idx) FILTER (hi < w - 20) AS c, max(idx) FILTER (sd > 0 AND hi < w - 5 * sd) AS e
  FROM oq WHERE idx >= 100 AND idx < takeoff AND oq.c = 3 GROUP BY trial_id)
SELECT ep.trial_id, a1 - 3 AS two_sided_run, coalesce(a1, a2) - 3 AS with_fallback, b - 3 AS relative_weight, g.c - 3 AS absolute_force, e - 3 AS last_crossing, departure AS final_departure, adaptive AS adaptive_trailing
FROM ep LEFT JOIN g USING (trial_id) LEFT JOIN fd USING (trial_id) LEFT JOIN ad USING (trial_id)""",
)
def onset_rules(spark, sf_dir):
    """Onset by each rule, before the same takeoff."""
    d, e, sd = placed(spark, sf_dir), F.col("epoch_end"), F.col("weight_sd")
    noise = lambda **x: L.onset_noise(c.force, c.weight, sd, 5.0, 3, 3, e, c.takeoff, **x)
    return d.select(
        "trial_id",
        noise(sides="two_sided").alias("two_sided_run"),
        noise(sides="two_sided", fraction=0.975).alias("with_fallback"),
        L.onset(c.force, 0.975 * c.weight, 3, 3, e, c.takeoff).alias("relative_weight"),
        L.onset(c.force, c.weight - 20, 3, 3, e, c.takeoff).alias("absolute_force"),
        noise(pick="last").alias("last_crossing"),
        L.onset_final_departure(c.force, c.weight, sd, 5.0, c.takeoff).alias("final_departure"),
        scans.trailing_onset(100, 5.0)("force").alias("adaptive_trailing"),
    )


RUNS = "runs AS (SELECT trial_id, min(idx) AS start, max(idx) AS stop FROM (SELECT trial_id, idx, idx - row_number() OVER (PARTITION BY trial_id ORDER BY idx) AS grp FROM s WHERE f < 20) GROUP BY trial_id, grp)"


@query("low_force_runs", f"WITH {SAMPLES_CTE}, {RUNS} SELECT trial_id, start, stop, round((stop - start + 1) / 100e0, 6) AS seconds, (stop - start + 1) / 100e0 BETWEEN 0.1e0 AND 2e0 AS accepted FROM runs")
def low_force_runs(spark, sf_dir):
    """Maximal runs of low force, with the flight-time acceptance of each."""
    d = trials(spark, sf_dir).select("trial_id", F.inline(A.runs(c.force, L.low(20.0)))).withColumnRenamed("end", "stop")
    seconds = (F.col("stop") - F.col("start") + 1) / 100.0
    return d.select("trial_id", "start", "stop", F.round(seconds, 6).alias("seconds"), seconds.between(0.1, 2.0).alias("accepted"))


@query(
    "takeoff_rules",
    BASE
    + f""", {RUNS},
lr AS (SELECT trial_id, arg_max(start, (stop - start) * 1000 - start) AS longest, count(*) FILTER (stop - start + 1 >= 3) AS qualifying, min(start) FILTER (stop - start + 1 >= 3) AS first_run, max(stop - start + 1) AS len FROM runs GROUP BY trial_id),
dc AS (SELECT trial_id, min(idx) AS descending FROM (SELECT trial_id, idx, f, lag(f) OVER y AS pf, max(f) OVER z AS hi, count(*) OVER z AS c FROM s
        WINDOW y AS (PARTITION BY trial_id ORDER BY idx), z AS (PARTITION BY trial_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) WHERE pf >= 20 AND f < 20 AND c = 2 AND hi < 20 GROUP BY trial_id),
pv AS (SELECT trial_id, min(idx) AS p FROM s WHERE idx >= 100 AND f <= 10 GROUP BY trial_id),
pq AS (SELECT trial_id, any_value(p) AS p, coalesce(min(idx) FILTER (idx >= p AND f > 10) - 1, max(idx)) AS q FROM s JOIN pv USING (trial_id) GROUP BY trial_id),
mid AS (SELECT trial_id, p, p + floor(0.25e0 * (q - p)) AS a, q - floor(0.25e0 * (q - p)) AS b FROM pq),
th AS (SELECT trial_id, any_value(p) AS p, CASE WHEN any_value(b - a) >= 2 THEN avg(f) FILTER (idx >= a AND idx < b) + 5 * stddev_samp(f) FILTER (idx >= a AND idx < b) ELSE 10 END AS t FROM s JOIN mid USING (trial_id) GROUP BY trial_id),
nt AS (SELECT trial_id, coalesce(min(idx) FILTER (idx >= 100 AND f <= t), any_value(p)) AS noise_takeoff, any_value(t) AS t FROM s JOIN th USING (trial_id) GROUP BY trial_id),
mg AS (SELECT trial_id, min(idx) AS magnitude FROM (SELECT trial_id, idx, max(abs(f)) OVER z AS hi, count(*) OVER z AS c FROM s WINDOW z AS (PARTITION BY trial_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)) WHERE idx >= 100 AND hi < 20 AND c = 3 GROUP BY trial_id),
mn AS (SELECT trial_id, min(idx) AS force_minimum FROM (SELECT trial_id, idx, f, min(f) OVER (PARTITION BY trial_id) AS lo FROM m WHERE idx < takeoff) WHERE f = lo GROUP BY trial_id)
SELECT lm.trial_id, lm.takeoff AS absolute, mg.magnitude, CASE WHEN len >= 3 THEN longest END AS longest_run, CASE WHEN len >= 3 THEN qualifying END AS qualifying_runs, CASE WHEN len >= 3 THEN longest = first_run END AS longest_is_first,
  descending, noise_takeoff, round(t, 6) AS noise_threshold, force_minimum
FROM lm LEFT JOIN lr USING (trial_id) LEFT JOIN dc USING (trial_id) LEFT JOIN nt USING (trial_id) LEFT JOIN mn USING (trial_id) LEFT JOIN mg USING (trial_id)""",
)
def takeoff_rules(spark, sf_dir):
    """Takeoff by each rule; the longest run reports how many runs qualified."""
    d = L.takeoff_flight_noise(placed(spark, sf_dir), F.col("epoch_end"))
    d = d.withColumn("runs", A.runs(c.force, L.low(20.0)))
    d = A.settled(d, best=L.takeoff_longest_run(F.col("runs"), 3))
    return d.select(
        "trial_id",
        c.takeoff.alias("absolute"),
        L.takeoff_absolute(c.force, F.col("epoch_end"), comparison="magnitude").alias("magnitude"),
        F.col("best.takeoff").alias("longest_run"),
        F.col("best.qualifying").cast("long").alias("qualifying_runs"),
        F.col("best.is_first").alias("longest_is_first"),
        L.takeoff_descending(c.force).alias("descending"),
        "noise_takeoff",
        *rounded(noise_threshold=F.col("noise_threshold")),
        A.argmin(c.force, 0, c.takeoff).alias("force_minimum"),
    )


@query(
    "landing_rules",
    BASE
    + """, un AS (SELECT trial_id, min(idx) AS u FROM s WHERE idx >= 100 AND f < 20 GROUP BY trial_id),
la AS (SELECT trial_id, min(idx) AS landing FROM (SELECT trial_id, idx, min(f) OVER z AS lo, count(*) OVER z AS c FROM s WINDOW z AS (PARTITION BY trial_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING)) JOIN un USING (trial_id)
       WHERE idx >= u AND lo >= 20 AND c = 2 GROUP BY trial_id)
SELECT lm.trial_id, landing AS absolute_force, touchdown AS tied_to_takeoff FROM lm LEFT JOIN la USING (trial_id)""",
)
def landing_rules(spark, sf_dir):
    """Landing by sustained contact, and the touchdown that goes with the takeoff."""
    d = placed(spark, sf_dir)
    return d.select("trial_id", L.landing_absolute(c.force, F.col("epoch_end")).alias("absolute_force"), c.touchdown.alias("tied_to_takeoff"))


@query(
    "integration_rules",
    BASE
    + f""", acc AS (SELECT trial_id, idx, idx - onset AS r, takeoff, onset, (f - w) / (w / {G}) AS a FROM m WHERE idx >= onset),
st AS (SELECT *, lag(a) OVER y AS a1, lag(a, 2) OVER y AS a2 FROM acc WINDOW y AS (PARTITION BY trial_id ORDER BY idx)),
e AS (SELECT trial_id, any_value(takeoff) AS takeoff, any_value(onset) AS onset,
  sum(0.005e0 * (a + a1)) FILTER (idx <= takeoff - 1) AS trapezoid, sum(0.01e0 * a1) FILTER (idx <= takeoff - 1) AS rectangle,
  sum(CASE WHEN r % 2 = 0 AND r >= 2 THEN (a2 + 4 * a1 + a) * 0.01e0 / 3 ELSE 0 END) FILTER (idx <= takeoff - 1 - (takeoff - 1 - onset) % 2)
    + coalesce(sum(0.005e0 * (a + a1)) FILTER (idx = takeoff - 1 AND (takeoff - 1 - onset) % 2 = 1), 0) AS simpson
  FROM st GROUP BY trial_id),
bk AS (SELECT trial_id, -sum(0.005e0 * (f - w + nf - w)) / any_value(w / {G}) AS backward FROM (SELECT *, lead(f) OVER (PARTITION BY trial_id ORDER BY idx) AS nf FROM m) WHERE idx >= onset AND idx < takeoff GROUP BY trial_id)
SELECT trial_id, """
    + sql_rounded(trapezoid="trapezoid", rectangle="rectangle", simpson="simpson", backward_at_onset="backward")
    + " FROM e JOIN bk USING (trial_id) WHERE onset < takeoff - 2",
)
def integration_rules(spark, sf_dir):
    """Takeoff velocity by each quadrature, and velocity at onset integrated back from takeoff."""
    d = placed(spark, sf_dir).where(c.onset < c.takeoff - 2)
    v = lambda rule: A.at(scans.integrated(rule)(Q.acceleration(), c.onset, c.dt), c.last)
    back = A.at(scans.integrated("trapezoid", "backward")(Q.acceleration(), c.takeoff, c.dt), c.onset)
    return d.select("trial_id", *rounded(trapezoid=v("trapezoid"), rectangle=v("rectangle"), simpson=v("simpson"), backward_at_onset=back))


@query(
    "jump_heights",
    BASE
    + f""", e AS (SELECT trial_id, any_value(w) AS w, any_value(touchdown - takeoff) / 100e0 AS ft, max(v) AS peak_v, max(v) FILTER (idx = takeoff - 1) AS vt, max(d) FILTER (idx = takeoff - 1) AS dt,
   max(d) FILTER (idx BETWEEN onset AND touchdown) AS rise, max(d) FILTER (idx BETWEEN takeoff AND touchdown) AS apex,
   sum(p) FILTER (idx BETWEEN onset AND takeoff - 1) - 0.5e0 * (max(p) FILTER (idx = onset) + max(p) FILTER (idx = takeoff - 1)) AS work, any_value(touchdown) AS td FROM k WHERE onset < takeoff GROUP BY trial_id)
SELECT trial_id, """
    + sql_rounded(
        peak_velocity=f"peak_v ** 2 / (2 * {G})",
        work_energy="0.01e0 * work / w",
        drop_from_box=f"CASE WHEN vt - sqrt(2 * {G} * 0.01e0) > 0 THEN (vt - sqrt(2 * {G} * 0.01e0)) ** 2 / (2 * {G}) END",
        ankle_corrected=f"{G} * ft ** 2 / 8 * (1 - 2 * 0.02e0 / ({G} * ft ** 2)) ** 2",
        standing_double_integral="CASE WHEN td IS NOT NULL THEN rise END",
        standing_velocity_plus_rise=f"dt + vt ** 2 / (2 * {G})",
        flight_plus_anthropometry=f"{G} * ft ** 2 / 8 + sin(1.2e0) * 0.13e0 + 0.03e0 - 0.08e0",
        flight_apex="CASE WHEN td IS NOT NULL THEN apex END",
        least_of_two=f"CASE WHEN ft IS NULL THEN NULL ELSE least(vt ** 2 / (2 * {G}), {G} * ft ** 2 / 8) END",
    )
    + " FROM e",
)
@whole
def jump_heights(spark, sf_dir):
    """Jump height by every rule, metres. Ankle shift, box and segment lengths are stated parameters."""
    d = moving(spark, sf_dir).transform(answerable)
    v, disp, ft = A.at(F.col("velocity"), c.last), F.col("displacement"), (c.touchdown - c.takeoff) * c.dt
    drop = v - F.sqrt(F.lit(2 * G * 0.01))
    work = T.area(F.col("net_power"), 0.0, c.onset, c.last, c.dt)
    span = lambda a, b: F.when(c.touchdown.isNotNull(), F.array_max(A.between(disp, a, b + 1)))
    flight = G * ft * ft / 8
    return d.select(
        "trial_id",
        "code",
        *rounded(
            peak_velocity=F.pow(F.array_max("velocity"), F.lit(2)) / (2 * G),
            work_energy=work / c.weight,
            drop_from_box=F.when(drop > 0, drop * drop / (2 * G)),
            ankle_corrected=flight * F.pow(1 - 2 * 0.02 / (G * ft * ft), F.lit(2)),
            standing_double_integral=span(c.onset, c.touchdown),
            standing_velocity_plus_rise=A.at(disp, c.last) + v * v / (2 * G),
            flight_plus_anthropometry=flight + F.sin(F.lit(1.2)) * 0.13 + 0.03 - 0.08,
            flight_apex=span(c.takeoff, c.touchdown),
            least_of_two=F.when(ft.isNotNull(), F.least(v * v / (2 * G), flight)),
        ),
    )


FORCE_AT = "max(f) FILTER (idx = {})"


@query(
    "force_and_rates",
    BASE
    + f""", c AS (SELECT *, lead(f, 2) OVER y - f AS rise2, lag(f) OVER y AS pf, lead(f) OVER y AS nf FROM m WHERE onset < takeoff WINDOW y AS (PARTITION BY trial_id ORDER BY idx)),
pk AS (SELECT trial_id, any_value(w) AS w, any_value(onset) AS onset, any_value(takeoff) AS takeoff, max(f) FILTER (idx BETWEEN onset AND takeoff) AS peak,
  {FORCE_AT.format("onset")} AS f0, {FORCE_AT.format("onset + 20")} AS f20, {FORCE_AT.format("onset + 10")} AS f10, {FORCE_AT.format("onset + 5")} AS f5,
  sum(f - w) FILTER (idx BETWEEN onset AND onset + 20) - 0.5e0 * (sum(f - w) FILTER (idx IN (onset, onset + 20))) AS imp,
  max(rise2) FILTER (idx BETWEEN onset AND takeoff - 2) AS steep FROM c GROUP BY trial_id),
pa AS (SELECT trial_id, min(idx) AS peak_at FROM c JOIN pk USING (trial_id) WHERE c.idx BETWEEN c.onset AND c.takeoff AND f = peak GROUP BY trial_id),
hp AS (SELECT trial_id, min(idx) AS hi_at FROM c JOIN pk USING (trial_id) WHERE c.idx BETWEEN c.onset + 20 AND c.takeoff AND f >= 1.5e0 * c.w GROUP BY trial_id),
ip AS (SELECT trial_id, hi_at - 1 + (1.5e0 * c.w - pf) / (f - pf) AS pos FROM c JOIN hp USING (trial_id) WHERE idx = hi_at),
lo AS (SELECT trial_id, min(idx) AS lo_at FROM c WHERE idx BETWEEN onset + 20 AND takeoff AND f >= 1.2e0 * w GROUP BY trial_id),
il AS (SELECT trial_id, lo_at - 1 + (1.2e0 * c.w - pf) / (f - pf) AS pos FROM c JOIN lo USING (trial_id) WHERE idx = lo_at),
cd AS (SELECT trial_id, max((nf - pf) / 0.02e0) FILTER (idx = floor(pos)) AS d0, max((nf - pf) / 0.02e0) FILTER (idx = floor(pos) + 1) AS d1, any_value(pos - floor(pos)) AS fr FROM c JOIN ip USING (trial_id) GROUP BY trial_id)
SELECT trial_id, """
    + sql_rounded(
        peak_gross="peak",
        peak_net="peak - w",
        force_at_200ms="f20",
        impulse_200ms="0.01e0 * imp",
        rfd_overlapping="(f20 - f0) / 0.2e0",
        rfd_second_50ms="(f10 - f5) / 0.05e0",
        rfd_steepest_20ms="steep / 0.02e0",
        rfd_at_level="d0 + (d1 - d0) * fr",
        rfd_between_levels="0.3e0 * w / ((ip.pos - il.pos) * 0.01e0)",
        rfd_average_to_peak="peak / ((peak_at - onset) * 0.01e0)",
        pct_of_net_peak="100 * (f20 - w) / (peak - w)",
    )
    + " FROM pk LEFT JOIN pa USING (trial_id) LEFT JOIN cd USING (trial_id) LEFT JOIN ip USING (trial_id) LEFT JOIN il USING (trial_id)",
)
@whole
def force_and_rates(spark, sf_dir):
    """Peak forces, force and impulse at 200 ms, rates of force development by every rule."""
    d = placed(spark, sf_dir).transform(answerable)
    peak = F.array_max(A.between(c.force, c.onset, c.takeoff + 1))
    f = lambda i: A.at(c.force, c.onset + i)
    hi, lo = (Q.level_crossing(c.force, x * c.weight, c.onset + 20, c.takeoff) for x in (1.5, 1.2))
    d = d.withColumn("hi", hi).withColumn("lo", lo)
    return d.select(
        "trial_id",
        "code",
        *rounded(
            peak_gross=peak,
            peak_net=peak - c.weight,
            force_at_200ms=f(20),
            impulse_200ms=Q.impulse(c.force, c.onset, c.onset + 20, c.weight),
            rfd_overlapping=Q.rise(c.force, c.onset, c.onset + 20, c.dt),
            rfd_second_50ms=Q.rise(c.force, c.onset + 5, c.onset + 10, c.dt),
            rfd_steepest_20ms=Q.steepest_chord(c.force, 2, c.onset, c.takeoff, c.dt),
            rfd_at_level=Q.centred_derivative(c.force, F.col("hi"), c.dt),
            rfd_between_levels=0.3 * c.weight / ((F.col("hi") - F.col("lo")) * c.dt),
            rfd_average_to_peak=peak / ((A.argmax(c.force, c.onset, c.takeoff + 1) - c.onset) * c.dt),
            pct_of_net_peak=100 * (f(20) - c.weight) / (peak - c.weight),
        ),
    )


@query(
    "power_and_work",
    BASE
    + f""", z AS (SELECT *, f * v AS gp FROM k WHERE onset < takeoff),
e AS (SELECT trial_id, any_value(w) AS w, any_value(onset) AS onset, any_value(takeoff) AS takeoff, any_value(touchdown - takeoff) / 100e0 AS ft, max(gp) FILTER (idx BETWEEN onset AND takeoff - 1) AS peak,
  sum(gp) FILTER (idx BETWEEN onset AND takeoff - 1) - 0.5e0 * sum(gp) FILTER (idx IN (onset, takeoff - 1)) AS area,
  max(f) FILTER (idx BETWEEN onset AND takeoff - 1) AS pf, max(d) FILTER (idx = takeoff - 1) - max(d) FILTER (idx = onset) AS climb, max(gp) FILTER (idx = onset) AS p0 FROM z GROUP BY trial_id),
t AS (SELECT trial_id, max(idx) AS peak_at FROM z JOIN e USING (trial_id) WHERE z.idx BETWEEN z.onset AND z.takeoff - 1 AND gp = peak GROUP BY trial_id)
SELECT trial_id, peak_at, """
    + sql_rounded(
        peak_power="peak",
        mean_power="0.01e0 * area / ((takeoff - 1 - onset) * 0.01e0)",
        work="0.01e0 * area",
        work_product="pf * climb",
        rate_of_power="(peak - p0) / ((peak_at - onset) * 0.01e0)",
        power_lewis=f"sqrt(4.9e0) * (w / {G}) * sqrt({G} * ft ** 2 / 8) * 9.81e0",
        power_harman=f"61.9e0 * ({G} * ft ** 2 / 8) / 0.01e0 + 36.0e0 * (w / {G}) - 1822.0e0",
        power_sayers=f"51.9e0 * ({G} * ft ** 2 / 8) / 0.01e0 + 48.9e0 * (w / {G}) - 2007.0e0",
        per_kilogram=f"peak / (w / {G})",
        allometric=f"peak / (w / {G}) ** 0.67e0",
        dimensionless=f"peak / ((w / {G}) * {G} ** 1.5e0 * sqrt(0.9e0))",
    )
    + " FROM e JOIN t USING (trial_id)",
)
@whole
def power_and_work(spark, sf_dir):
    """Peak and mean power, work, rate of power, regressions from height, and normalised peak power."""
    d = moving(spark, sf_dir).transform(answerable)
    d = d.withColumn("power", A.between(F.zip_with("force", "velocity", lambda f, v: f * v), c.onset, c.takeoff)).withColumn("peak", F.array_max("power"))
    mass, flight = c.weight / G, G * F.pow((c.touchdown - c.takeoff) * c.dt, F.lit(2)) / 8
    peak_at = c.onset + F.size("power") - F.array_position(F.reverse("power"), F.col("peak")).cast("int")
    work = T.area(F.col("power"), 0.0, 0, F.size("power") - 1, c.dt)
    climb = A.at(F.col("displacement"), c.last) - A.at(F.col("displacement"), c.onset)
    regression = lambda x: x[0] * flight / x[1] + x[2] * mass + x[3]
    return d.select(
        "trial_id",
        "code",
        peak_at.alias("peak_at"),
        *rounded(
            peak_power=F.col("peak"),
            mean_power=work / ((c.last - c.onset) * c.dt),
            work=work,
            work_product=F.array_max(A.between(c.force, c.onset, c.takeoff)) * climb,
            rate_of_power=(F.col("peak") - F.get("power", F.lit(0))) / ((peak_at - c.onset) * c.dt),
            power_lewis=F.sqrt(F.lit(4.9)) * mass * F.sqrt(flight) * 9.81,
            power_harman=regression(Q.POWER_REGRESSIONS["harman1991"]),
            power_sayers=regression(Q.POWER_REGRESSIONS["sayers1999_countermovement"]),
            per_kilogram=F.col("peak") / mass,
            allometric=F.col("peak") / F.pow(mass, F.lit(0.67)),
            dimensionless=F.col("peak") / (mass * G**1.5 * F.sqrt(F.lit(0.9))),
        ),
    )


for _name in ("jump_heights", "force_and_rates", "power_and_work"):
    ORACLES[_name] = whole_sql(ORACLES[_name])
