"""Registered queries on sources, samples, conditioning and curve sets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cols as c
from ..functions import filters as X
from ..functions import traces as T
from ..operators import landmarks as L
from ..operators import quantities as Q
from ..operators import waveform as V
from ..sources import files
from ..sources import store
from ..sources.trials import RATE_HZ, SAMPLES_CTE, trials
from .trial_queries import answerable, placed, rounded, whole

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


WITH = f"WITH {SAMPLES_CTE} "
TEXTS = "'AT' || o_custkey || '_' || o_orderkey || '.force.txt'"


@query(
    "file_identity",
    f"""WITH n AS (SELECT o_orderkey, CASE WHEN o_orderkey % 13 = 0 THEN 'notes_' || o_orderkey || '.csv' ELSE {TEXTS} END AS name FROM orders),
p AS (SELECT o_orderkey, name, regexp_extract(name, '^AT(.+?)_(.+?)\\.force\\.txt$', 1) AS subject, regexp_extract(name, '^AT(.+?)_(.+?)\\.force\\.txt$', 2) AS trial FROM n)
SELECT o_orderkey, subject, trial, CASE WHEN NOT suffix(name, '.force.txt') THEN 'without_suffix' WHEN trial = '' THEN 'unidentified' WHEN count(*) OVER (PARTITION BY subject, CASE WHEN trial <> '' THEN trial::BIGINT % 1000 END) > 1 THEN 'duplicate' ELSE 'ok' END AS status FROM p""",
)
def file_identity(spark, sf_dir):
    """Names read by a template; names without the suffix are counted; two files that claim one trial are both refused."""
    d = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    name = F.when(F.col("o_orderkey") % 13 == 0, F.concat(F.lit("notes_"), "o_orderkey", F.lit(".csv"))).otherwise(
        F.concat(F.lit("AT"), "o_custkey", F.lit("_"), "o_orderkey", F.lit(".force.txt"))
    )
    d = files.identify(d.select("o_orderkey", name.alias("name")), "name", "AT{subject}_{trial}", ".force.txt")
    claim = F.when(F.col("trial") != "", F.col("trial").cast("long") % 1000)
    return files.refuse_duplicates(d.withColumn("claim", claim), ["subject", "claim"]).select("o_orderkey", "subject", "trial", "status")


@query("read_delimited", WITH + "SELECT trial_id, count(*) AS rows, 2::BIGINT AS blank_lines, (CASE WHEN any_value(trial_id) % 50 = 0 THEN 1 ELSE 0 END)::BIGINT AS bad_rows, round(sum(f), 4) AS total FROM s GROUP BY trial_id")
def read_delimited(spark, sf_dir):
    """Files of tab-separated rows read back: the chosen column as samples, blank lines skipped, bad rows counted with their line."""
    bad = F.when(F.col("trial_id") % 50 == 0, F.lit("\n\n\n290\tnot-a-number\t0")).otherwise("\n\n")
    d = trials(spark, sf_dir).select("trial_id", files.text_lines(c.force, "{i}\t{x}\t0", bad).alias("text"))
    d = files.read_column(d, "text", "\t", 1)
    return d.select("trial_id", F.size("values").cast("long").alias("rows"), "blank_lines", F.size("bad_lines").cast("long").alias("bad_rows"), F.round("total", 4).alias("total"))


@query(
    "column_summary",
    """WITH e AS (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events)
SELECT user_id, count(*) AS n, round(min(value), 6) AS least, round(max(value), 6) AS greatest, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(stddev_samp(value), 6) AS sd, count(*) FILTER (value = 0) AS zeros, coalesce(bool_and(step > 0), true) AS increasing, coalesce(max(step) - min(step) <= 1e-9, true) AS even FROM e GROUP BY user_id""",
)
def column_summary(spark, sf_dir):
    """Summary of a column per source: range, centre, spread, zeros, whether it only rises and in even steps."""
    d = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    return files.summarise(d, "user_id", ["ts", "event_id"], "value").withColumns({x: F.round(x, 6) for x in ("least", "greatest", "mean", "median", "sd")})


@query(
    "suggested_column",
    "WITH u AS (SELECT l_suppkey, unnest([{'name': 'l_quantity', 'v': l_quantity::DOUBLE}, {'name': 'l_extendedprice', 'v': l_extendedprice::DOUBLE}, {'name': 'l_discount', 'v': l_discount::DOUBLE}], recursive := true) FROM lineitem), g AS (SELECT l_suppkey, name, median(v) AS md, stddev_samp(v) AS sd FROM u GROUP BY ALL) SELECT l_suppkey, arg_max(name, sd) AS suggested, count(*) AS candidates FROM g WHERE md > 50 AND sd > 0 GROUP BY l_suppkey",
)
def suggested_column(spark, sf_dir):
    """Per source, the column that looks like force: median over 50, and of those the greatest deviation."""
    d = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    d = d.select("l_suppkey", *[F.col(x).cast("double").alias(x) for x in names])
    row = lambda x: F.struct(F.lit(x).alias("name"), F.median(x).alias("md"), F.stddev_samp(x).alias("sd"))
    d = d.groupBy("l_suppkey").agg(F.array(*[row(x) for x in names]).alias("a"))
    fit = F.filter("a", lambda x: (x["md"] > 50) & (x["sd"] > 0))
    best = F.array_max(F.transform(fit, lambda x: F.struct(x["sd"], x["name"])))
    return d.select("l_suppkey", best["name"].alias("suggested"), F.size(fit).cast("long").alias("candidates")).where("candidates > 0")


@query("decimated", WITH + ", b AS (SELECT trial_id, idx, f, count(*) OVER (PARTITION BY trial_id) AS n FROM s) SELECT trial_id, floor(((idx + 1) * 40 - 1) / n)::INT AS bucket, round(avg(f), 6) AS mean FROM b GROUP BY ALL")
def decimated(spark, sf_dir):
    """Traces drawn down to 40 bucket means (a sample that is no number counts as zero)."""
    n = F.size("force")
    return trials(spark, sf_dir).select("trial_id", F.posexplode(files.decimate(c.force, n, 40)).alias("bucket", "mean")).withColumn("mean", F.round("mean", 6))


@query(
    "trace_repairs",
    WITH
    + f", q AS (SELECT trial_id, avg(f) FILTER (idx >= 205 AND idx < 245 AND f = 0) AS unloaded, count(*) FILTER (f = 0) AS marked, max(f) AS top, count(*) AS n FROM s GROUP BY trial_id) SELECT trial_id, round(coalesce(unloaded, 0), 6) AS offset, abs(coalesce(unloaded, 0)) <= 5 AS tared, marked, round(top - coalesce(unloaded, 0), 6) AS top_without_offset, round(top + 70 * {G}, 6) AS top_rebuilt, n - marked AS kept FROM q",
)
def trace_repairs(spark, sf_dir):
    """Baseline offset of the unloaded plate, tare finding, missing markers, and absolute force of a tared plate."""
    d = trials(spark, sf_dir)
    free = A.let(A.between(c.force, 205, 245), lambda x: A.mean(F.filter(x, lambda y: y == 0)))
    d = A.settled(d, offset=F.coalesce(free, F.lit(0.0)))
    marked = F.filter(c.force, lambda x: x == 0)
    return d.select(
        "trial_id",
        F.round("offset", 6).alias("offset"),
        (F.abs("offset") <= 5).alias("tared"),
        F.size(marked).cast("long").alias("marked"),
        *rounded(
            top_without_offset=F.array_max(F.transform("force", lambda x: x - F.col("offset"))),
            top_rebuilt=F.array_max(F.transform("force", lambda x: x + 70 * G)),
        ),
        (F.size("force") - F.size(marked)).cast("long").alias("kept"),
    )


@query(
    "local_gravity",
    "WITH x AS (SELECT n_nationkey, n_regionkey, sin(n_nationkey * 3.6e0 * 0.017453292519943295e0) ** 2 AS s FROM nation) "
    "SELECT n_nationkey, round(9.7803267715e0 * (1 + 0.0052790414e0 * s + 0.0000232718e0 * s ** 2 + 0.0000001262e0 * s ** 3 + 0.0000000007e0 * s ** 4) - 3.086e-6 * 100 * n_regionkey, 9) AS g FROM x",
)
def local_gravity(spark, sf_dir):
    """Gravity by latitude and elevation."""
    lat = F.col("n_nationkey") * 3.6 * 0.017453292519943295
    g = files.gravity_at(lat, 100 * F.col("n_regionkey"))
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.round(g, 9).alias("g"))


BOXCAR = WITH + """, b AS (SELECT trial_id, idx, f, avg(f) OVER z AS a, count(*) OVER z AS k, max(idx) OVER (PARTITION BY trial_id) AS last FROM s WINDOW z AS (PARTITION BY trial_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
x AS (SELECT trial_id, max(a) FILTER (idx = 2) AS head, max(a) FILTER (idx = last - 2) AS tail FROM b GROUP BY trial_id),
y AS (SELECT trial_id, idx, CASE WHEN idx < 2 THEN head WHEN idx > last - 2 THEN tail ELSE a END AS m FROM b JOIN x USING (trial_id)) """


@query("moving_average", BOXCAR + "SELECT trial_id, idx, round(m, 6) AS mean FROM y")
def moving_average(spark, sf_dir):
    """Five-sample boxcar, the ends holding the end windows' means."""
    d = trials(spark, sf_dir).select("trial_id", F.posexplode(Q.moving_average(c.force, 5)).alias("idx", "mean"))
    return d.withColumn("mean", F.round("mean", 6))


@query("peak_estimator", BOXCAR + "SELECT trial_id, round(max(m), 6) AS peak FROM y WHERE idx < 205 GROUP BY trial_id")
def peak_estimator(spark, sf_dir):
    """Peak of the smoothed force before flight."""
    return trials(spark, sf_dir).select("trial_id", *rounded(peak=F.array_max(A.between(Q.moving_average(c.force, 5), 0, 205))))


@query("residual_statistics", WITH + ", r AS (SELECT trial_id, idx, f - avg(f) OVER (PARTITION BY trial_id) AS e FROM s WHERE idx < 100), d AS (SELECT trial_id, idx, e, e - lag(e) OVER (PARTITION BY trial_id ORDER BY idx) AS de FROM r) SELECT trial_id, round(sqrt(avg(e * e)), 6) AS rms, round(sum(de * de) / nullif(sum(e * e), 0), 6) AS durbin_watson, round(regr_slope(e, idx), 9) AS slope FROM d GROUP BY trial_id")
def residual_statistics(spark, sf_dir):
    """Residual RMS, Durbin-Watson statistic (null where nothing varies) and drift of quiet standing."""
    d = trials(spark, sf_dir).select("trial_id", T.residuals(c.force, 0, 100).alias("r"))
    return d.select("trial_id", *rounded(rms=F.col("r.rms"), durbin_watson=F.col("r.durbin_watson")), F.round("r.slope", 9).alias("slope"))


@query("low_pass_force")
def low_pass_force(spark, sf_dir):
    """Peak force after a zero-lag Butterworth low pass."""
    d = trials(spark, sf_dir).select("trial_id", "force")
    d = V.per_trace(d, "force", "peak", lambda x: X.low_pass(x, 20.0, RATE_HZ).max(1).tolist(), array=False)
    return d.select("trial_id", *rounded(peak=F.col("peak")))


@query("polynomial_smoothing")
def polynomial_smoothing(spark, sf_dir):
    """Peak force after Savitzky-Golay smoothing."""
    d = trials(spark, sf_dir).select("trial_id", "force")
    return V.per_trace(d, "force", "peak", lambda x: X.polynomial_smooth(x, 9, 3).max(1).tolist(), array=False)


@query("spectrum_cutoff")
def spectrum_cutoff(spark, sf_dir):
    """Frequency that keeps 99 % of the power of each trace."""
    return V.per_trace(trials(spark, sf_dir).select("trial_id", "force"), "force", "cutoff_hz", lambda x: X.share_cutoff(x, RATE_HZ).tolist(), array=False)


CUTOFFS = np.arange(4.0, 41.0, 2.0)


#: Traces whose residuals under all cutoffs are held at once.
HELD = 107


def _of_residuals(x: np.ndarray, measure) -> np.ndarray:
    """measure of the residuals (traces, cutoffs, samples) of blocks of the traces: a row for each trace, a column for each cutoff."""
    parts = (x[at : at + HELD] for at in range(0, len(x), HELD))
    return np.concatenate([measure(part[:, None, :] - X.low_passes(part, CUTOFFS, RATE_HZ)) for part in parts])


def _rms(residuals: np.ndarray) -> np.ndarray:
    return np.sqrt((residuals**2).mean(2))


@query("cutoff_by_residuals")
def cutoff_by_residuals(spark, sf_dir):
    """Low-pass cutoff by residual analysis: candidates are tried inside the task, per trace."""
    pick = lambda x: X.residual_cutoff(_of_residuals(x, _rms), CUTOFFS, 6).tolist()
    return V.per_trace(trials(spark, sf_dir).select("trial_id", "force"), "force", "cutoff_hz", pick, array=False)


#: Samples on each side of a step, and how many times the noise of their means it must be.
STEP_WIDE, STEP_RATIO = 10, 12.0


@query("quiet_cutoff")
def quiet_cutoff(spark, sf_dir):
    """Cutoff by residual analysis of the quiet stance and of the flight's way down; null where a step lies inside, told with its place."""
    names = {"stance": A.between(c.force, 0, 150), "to_landing": A.between(c.force, F.size("force") - 100, F.size("force"))}
    rows = F.array(*[F.struct(F.lit(n).alias("part"), v.alias("x")) for n, v in names.items()])
    d = trials(spark, sf_dir).select("trial_id", F.inline(rows))

    def pick(x: np.ndarray) -> list:
        step = X.step_place(x, STEP_WIDE, STEP_RATIO)
        best = X.residual_cutoff(_of_residuals(x, _rms), CUTOFFS, 6)
        return np.column_stack((step, best)).tolist()

    d = V.per_trace(d, "x", "found", pick)
    step = F.get("found", F.lit(0)).cast("int")
    return d.select("trial_id", "part", F.when(step >= 0, step).alias("step_at"), F.when(step < 0, F.get("found", F.lit(1))).alias("cutoff_hz"))


@query("cutoff_by_whiteness")
def cutoff_by_whiteness(spark, sf_dir):
    """Low-pass cutoff whose residuals look most like white noise."""

    def whiteness(residuals: np.ndarray) -> np.ndarray:
        return X.durbin_watson(residuals.reshape(-1, residuals.shape[2])).reshape(residuals.shape[:2])

    pick = lambda x: CUTOFFS[np.abs(_of_residuals(x, whiteness) - 2).argmin(1)].tolist()

    return V.per_trace(trials(spark, sf_dir).select("trial_id", "force"), "force", "cutoff_hz", pick, array=False)


@query("exponential_rate")
@whole
def exponential_rate(spark, sf_dir):
    """Rate of force development by an exponential rise fitted from onset to the peak, and its residual in percent."""
    d = placed(spark, sf_dir).transform(answerable)
    d = d.select("trial_id", "code", A.between(c.force, c.onset, A.argmax(c.force, c.onset, c.takeoff) + 1).alias("rise"))

    def fit(x: np.ndarray) -> list:
        _, size, tau, residual = X.exponential_rises(x, 1 / RATE_HZ)
        return [v if ok else None for v, ok in zip(np.column_stack((size / tau, residual)).tolist(), np.isfinite(size))]

    d = V.per_trace(d, "rise", "fit", fit)
    return d.select("trial_id", "code", F.get("fit", F.lit(0)).alias("rate"), F.get("fit", F.lit(1)).alias("residual_percent"))


def curves(spark, sf_dir) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("y"))


CURVES = "WITH p AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS point FROM embeddings) "


@query("mean_curve", CURVES + "SELECT label, point, round(avg(y), 6) AS mean, count(*) AS curves FROM p GROUP BY ALL")
def mean_curve(spark, sf_dir):
    """Mean curve of each group."""
    return V.points(curves(spark, sf_dir), "vec_id", "y", "label").groupBy("label", "point").agg(F.round(F.avg("y"), 6).alias("mean"), F.count("*").alias("curves"))


@query("curve_covariance", CURVES + "SELECT a.point AS row, b.point AS col, round(covar_samp(a.y, b.y), 8) AS covariance FROM p a JOIN p b USING (vec_id) GROUP BY ALL")
def curve_covariance(spark, sf_dir):
    """Covariance of the curve set, from each task's own sums."""
    _, _, cov = V.covariance(curves(spark, sf_dir), "y")
    rows = [(i, j, float(cov[i, j])) for i in range(len(cov)) for j in range(len(cov))]
    return spark.createDataFrame(rows, "row int, col int, covariance double").withColumn("covariance", F.round("covariance", 8))


@query("curve_scores")
def curve_scores(spark, sf_dir):
    """Scores of every curve on the components that hold 90 % of the variance."""
    d = curves(spark, sf_dir)
    _, mean, cov = V.covariance(d, "y")
    _, vectors = V.components(cov, 0.9)
    return V.per_trace(d.select("vec_id", "y"), "y", "scores", lambda x: list((x - mean) @ vectors))


@query("characterising_phases")
def characterising_phases(spark, sf_dir):
    """Scores on varimax-rotated components of smoothed curves: each curve's mean over a component's region of high loading."""
    hat = X.smoothing_matrix(64, 20, 1e-2)
    d = V.per_trace(curves(spark, sf_dir).select("vec_id", "y"), "y", "y2", lambda x: list(x @ hat.T)).withColumnRenamed("y2", "y")
    _, _, cov = V.covariance(d, "y")
    values, vectors = V.components(cov, 0.6)
    load = np.abs(X.varimax(vectors * np.sqrt(values)))
    regions = [np.flatnonzero(v >= 0.7 * v.max()) for v in load.T]
    return V.per_trace(d, "y", "scores", lambda x: [np.array([row[r].mean() for r in regions]) for row in x])


T_SQL = CURVES + """, g AS (SELECT point, avg(y) FILTER (label = 0) AS m0, avg(y) FILTER (label = 1) AS m1, var_samp(y) FILTER (label = 0) AS v0, var_samp(y) FILTER (label = 1) AS v1, count(*) FILTER (label = 0) AS n0, count(*) FILTER (label = 1) AS n1 FROM p WHERE label IN (0, 1) GROUP BY point),
t AS (SELECT point, coalesce((m0 - m1) / nullif(sqrt(((n0 - 1) * v0 + (n1 - 1) * v1) / (n0 + n1 - 2) * (1e0 / n0 + 1e0 / n1)), 0), 0) AS t FROM g) """


@query("t_continuum", T_SQL + "SELECT point, round(t, 6) AS t FROM t")
def t_continuum(spark, sf_dir):
    """Pointwise t between two groups of curves."""
    return V.two_sample_t(curves(spark, sf_dir), "label", "y", 0, 1).withColumn("t", F.round("t", 6))


@query("t_clusters", T_SQL + ", c AS (SELECT point, t, point - row_number() OVER (ORDER BY point) AS grp FROM t WHERE abs(t) > 1) SELECT min(point) AS start, max(point) AS stop, count(*) AS extent, round(max(abs(t)), 6) AS peak FROM c GROUP BY grp")
def t_clusters(spark, sf_dir):
    """Runs of points over a threshold."""
    return V.clusters(V.two_sample_t(curves(spark, sf_dir), "label", "y", 0, 1), 1.0).withColumn("peak", F.round("peak", 6))


@query(
    "sign_flips",
    CURVES + ", f AS (SELECT perm, point, y * CASE WHEN perm = 0 OR substr(md5(perm || '_' || vec_id), 1, 1) < '8' THEN 1 ELSE -1 END AS x FROM p CROSS JOIN range(20) AS r(perm)), g AS (SELECT perm, point, coalesce(abs(avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0)), 0) AS t FROM f GROUP BY ALL) SELECT perm::INT AS perm, round(max(t), 6) AS greatest FROM g GROUP BY perm",
)
def sign_flips(spark, sf_dir):
    """Field maximum of every sign-flip permutation; number 0 is the data."""
    return V.sign_flip_maxima(curves(spark, sf_dir), "vec_id", "y", 20).withColumn("greatest", F.round("greatest", 6))


@query("sign_flip_threshold")
def sign_flip_threshold(spark, sf_dir):
    """Whether the data's field maximum is over the 5 % threshold of 1,000 sign flips."""
    d = V.sign_flip_maxima(curves(spark, sf_dir), "vec_id", "y", 1001).persist()
    threshold = V.permutation_threshold(d)
    return d.where("perm = 0").select("greatest", F.lit(threshold).alias("threshold"), (F.col("greatest") > threshold).alias("significant"))


@query("label_shuffle_clusters")
def label_shuffle_clusters(spark, sf_dir):
    """The two-group test against the 5 % threshold of 1,000 label shuffles, with the clusters over it."""
    d = curves(spark, sf_dir)
    threshold = V.permutation_threshold(V.label_shuffle_maxima(d, "vec_id", "label", "y", 0, 1, 1000))
    return V.inference(V.two_sample_t(d, "label", "y", 0, 1), threshold)


@query("random_field_clusters")
def random_field_clusters(spark, sf_dir):
    """The two-group test against the random-field threshold, with the clusters over it."""
    d = curves(spark, sf_dir).where("label IN (0, 1)")
    threshold = V.random_field_threshold(V.smoothness(d, "y"), 64, d.count() - 2)
    return V.inference(V.two_sample_t(d, "label", "y", 0, 1), threshold)


@query("normalised_curves")
def normalised_curves(spark, sf_dir):
    """The movement, onset to takeoff, as 101 points of a not-a-knot spline."""
    d = placed(spark, sf_dir).where(c.ordered).select("trial_id", A.between(c.force, c.onset, c.takeoff).alias("phase"))
    return V.per_trace(d, "phase", "curve", lambda x: list(X.spline_resample(x, 101)))


@query("registered_curves")
def registered_curves(spark, sf_dir):
    """Movements registered on their force minimum."""
    d = placed(spark, sf_dir).where(c.ordered).select("trial_id", A.between(c.force, c.onset, c.takeoff).alias("y"))
    return V.register(d.withColumn("landmark", A.argmin(F.col("y"), 0, F.size("y"))), "trial_id", "y", "landmark")


@query("warped_curves")
def warped_curves(spark, sf_dir):
    """Cost of warping each movement, at 51 points, to the mean movement."""
    d = placed(spark, sf_dir).where(c.ordered).select("trial_id", A.between(c.force, c.onset, c.takeoff).alias("phase"))
    d = V.per_trace(d, "phase", "y", lambda x: list(X.spline_resample(x, 51)))
    _, mean, _ = V.covariance(d, "y")
    return V.warped_cost(d, "trial_id", "y", mean.tolist(), 10)


@query("warp_pairs")
def warp_pairs(spark, sf_dir):
    """The path that carries each movement, at 51 points, to the mean movement: a row for each pair of places."""
    d = placed(spark, sf_dir).where(c.ordered).select("trial_id", A.between(c.force, c.onset, c.takeoff).alias("phase"))
    d = store.written(V.per_trace(d, "phase", "y", lambda x: list(X.spline_resample(x, 51))), "movements")
    _, mean, _ = V.covariance(d, "y")
    return V.warped_pairs(d, "trial_id", "y", mean.tolist(), 10)


@query("functional_scores")
def functional_scores(spark, sf_dir):
    """Functional components: curves as 20 basis coefficients, their covariance, and every curve's scores for 90 % of the variance."""
    basis = X.spline_basis(64, 20)
    solve = np.linalg.solve(basis.T @ basis + 1e-2 * X.roughness(20), basis.T)
    d = V.per_trace(curves(spark, sf_dir).select("vec_id", "y"), "y", "c", lambda x: list(x @ solve.T))
    _, mean, cov = V.covariance(d, "c")
    _, vectors = V.components(cov, 0.9)
    return V.per_trace(d, "c", "scores", lambda x: list((x - mean) @ vectors))


@query("filter_gain")
def filter_gain(spark, sf_dir):
    """Gain of the zero-lag low pass at ten frequencies on the length of each trace: root mean square of a filtered sine times root two."""
    d = trials(spark, sf_dir).select(F.size("force").alias("n")).groupBy("n").agg(F.count("*").alias("trials"))
    d = d.select("n", "trials", F.explode(F.array(*[F.lit(float(f)) for f in range(2, 21, 2)])).alias("hz"))
    wave = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.sin(2 * np.pi * F.col("hz") * i / RATE_HZ))
    gain = lambda x: (np.sqrt(2 * (X.low_pass(x, 10.0, RATE_HZ)[:, 60:-60] ** 2).mean(1))).tolist()
    return V.per_trace(d.withColumn("wave", wave), "wave", "gain", gain, array=False)


@query("smoothing_penalties")
def smoothing_penalties(spark, sf_dir):
    """The penalty that cross-validation picks for each curve."""
    return V.per_trace(curves(spark, sf_dir).select("vec_id", "y"), "y", "penalty", lambda x: X.best_penalty(x, 20), array=False)
