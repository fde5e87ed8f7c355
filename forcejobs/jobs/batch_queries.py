"""Registered queries on runs as a whole: files on disk, seven relations of one pass, bundles with their record, grids of rules."""

from __future__ import annotations

import functools
import hashlib
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import cols as c
from ..functions import traces as T
from ..operators import batch, chains
from ..operators import cohort as C
from ..operators import landmarks as L
from ..operators import quantities as Q
from ..sources import bundle, files, folders, store
from ..sources.trials import RATE_HZ, SAMPLES_CTE, trials, trials_of_orders
from .cohort_queries import ranked
from .trial_queries import BASE, RESULTS_SQL, rounded

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


SUFFIXES, TEMPLATE = [".txt", ".force.txt"], "AT{subject}_{trial}"
#: A trial's file by its key: some lack a suffix or an identity, some have the shorter suffix.
FILE_NAME = (
    "CASE WHEN trial_id % 13 = 0 THEN concat('notes_', trial_id, '.csv') WHEN trial_id % 17 = 0 THEN concat('AT_', trial_id, '.force.txt') "
    "WHEN trial_id % 19 = 0 THEN concat('AT', subject, '_', trial_id, '.txt') ELSE concat('AT', subject, '_', trial_id, '.force.txt') END"
)


#: Trials whose files are in the shared folder at once: two gigabytes of blocks, however many trials there are.
FOLDER_TRIALS = 200_000


def folder_of(spark, trials: DataFrame) -> str:
    """A folder of files, one for each trial in its year's folder: some hold no text or a bad line, some are there twice."""
    root = f"{store.shared_folder(spark)}/trials-{uuid.uuid4().hex}"
    root = root if ":/" in root else f"file://{root}"
    d = trials.withColumn("name", F.expr(FILE_NAME))
    text = folders.text_of(c.force)
    text = F.when(F.col("trial_id") % 29 == 0, F.concat(text, F.lit("dropped\n").cast("binary"))).otherwise(text)
    text = F.when(F.col("trial_id") % 23 == 0, F.concat(F.lit(b"\xff\xfe"), text)).otherwise(text)
    paths = F.array(F.concat_ws("/", F.col("occasion").cast("string"), "name"))
    paths = F.when(F.col("trial_id") % 31 == 0, F.concat(paths, F.array(F.concat(F.lit("copies/again/"), "name")))).otherwise(paths)
    folders.write_files(d.select(F.explode(paths).alias("path"), text.alias("content")), root)
    return root


@query(
    "folder_run",
    f"""WITH {SAMPLES_CTE}, t AS (SELECT trial_id, any_value(subject) AS subject, any_value(occasion) AS occasion, count(*) AS n, sum(f) AS total FROM s GROUP BY trial_id),
nm AS (SELECT *, {FILE_NAME} AS name FROM t),
pt AS (SELECT *, occasion || '/' || name AS path FROM nm UNION ALL SELECT *, 'copies/again/' || name FROM nm WHERE trial_id % 31 = 0),
st AS (SELECT *, CASE WHEN trial_id % 13 = 0 THEN 'without_suffix' WHEN trial_id % 17 = 0 THEN 'unidentified' WHEN trial_id % 31 = 0 THEN 'duplicate' WHEN trial_id % 23 = 0 THEN 'unreadable' WHEN trial_id % 29 = 0 THEN 'bad_lines' ELSE 'ok' END AS status FROM pt)
SELECT path, CASE WHEN trial_id % 13 = 0 THEN NULL WHEN trial_id % 17 <> 0 AND trial_id % 19 = 0 THEN '.txt' ELSE '.force.txt' END AS suffix, status,
  CASE WHEN status NOT IN ('without_suffix', 'unidentified') THEN subject END AS subject, CASE WHEN status NOT IN ('without_suffix', 'unidentified') THEN trial_id END AS trial,
  CASE WHEN status IN ('ok', 'bad_lines') THEN n END AS samples, CASE WHEN status IN ('ok', 'bad_lines') THEN round(total, 3) END AS total FROM st""",
)
def folder_run(spark, sf_dir):
    """A folder of trial files at any depth, written from the orders, listed and read: a row a file, whatever it holds.

    The folder is filled, read and emptied for a share of the trials at a time; which files claim one trial is asked of all.
    """
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    shares = -(-orders.count() // FOLDER_TRIALS) or 1
    table = f"{store.shared_folder(spark)}/folder-run-{uuid.uuid4().hex}"
    for share in range(shares):
        root = folder_of(spark, trials_of_orders(orders.where(F.pmod(F.xxhash64("o_orderkey"), F.lit(shares)) == share)))
        listed = folders.listing(spark, root)
        read = folders.opened(folders.named_files(listed, SUFFIXES, TEMPLATE), root)
        read.withColumn("samples", F.size("values").cast("long")).drop("values").write.mode("append").parquet(table)
        folders.remove_files(listed, root)
        store.discard(spark, root)
    read = spark.read.parquet(table)
    d = folders.by_content(files.refuse_duplicates(read, files.template_pattern(TEMPLATE, "")[1]))
    number = lambda x: F.col(x).try_cast("long").alias(x)
    return d.select("path", "suffix", "status", number("subject"), number("trial"), "samples", F.round("total", 3).alias("total"))


def analysed(spark, sf_dir) -> DataFrame:
    """Every trial of the orders, analysed once and written: what is shown of it is read from there."""
    return store.written(batch.analyse(trials(spark, sf_dir), F.expr(FILE_NAME)), "analysed")


_BITS = "(q.w IS NOT NULL)::INT + 2 * (takeoff IS NOT NULL)::INT + 4 * (onset IS NOT NULL)::INT + 8 * (touchdown IS NOT NULL)::INT + 16 * coalesce(onset < takeoff, false)::INT"
_NULLS = " + ".join(f"({q} IS NULL)::INT" for q in batch.QUANTITIES)
_SUM = " + ".join(f"coalesce({q}, 0)" for q in batch.QUANTITIES)
#: pt: per trial, how many rows each relation has of it.
PARTS_SQL = (
    RESULTS_SQL
    + f""", gq AS (SELECT trial_id, any_value(w) AS w, any_value(sd) AS sd, max(abs(f - w)) FILTER (idx >= 100 AND idx < onset) AS tension, min(f) FILTER (idx >= 100 AND idx < onset) AS lowest, min(f) FILTER (idx < takeoff) AS deepest FROM m GROUP BY trial_id),
pt AS (SELECT q.*, {_BITS} AS bits, {_NULLS} AS nulls, {_SUM} AS told, 100 * abs(height_takeoff - height_flight) / height_flight AS apart,
  coalesce(takeoff IS NOT NULL AND touchdown IS NULL, false)::INT + coalesce(q.sd <= 0, false)::INT AS warned, 1 + coalesce(onset + 3 = 100, false)::INT + coalesce(onset >= takeoff, false)::INT AS signalled,
  coalesce(tension > 100, false)::INT + coalesce(tension > 0.1e0 * gq.w, false)::INT + coalesce(lowest < gq.w - 5 * gq.sd, false)::INT AS applied, coalesce(gq.w - deepest > 250, false)::INT AS typed,
  CASE WHEN tension > 100 THEN tension ELSE 0 END + CASE WHEN tension > 0.1e0 * gq.w THEN tension ELSE 0 END + CASE WHEN lowest < gq.w - 5 * gq.sd THEN lowest ELSE 0 END + CASE WHEN gq.w - deepest > 250 THEN gq.w - deepest ELSE 0 END AS seen
  FROM q JOIN gq USING (trial_id))
"""
)
_LINES = "[" + ", ".join(str(len(lines)) for _, lines in batch.chains()) + "]"
_IDS = "[" + ", ".join(f"'{i}'" for i, _ in batch.chains()) + "]"
COUNTS_SQL = (
    PARTS_SQL
    + f""", rc AS (SELECT 'results' AS relation, count(*) AS rows, count(*) AS trials, sum(height_takeoff) AS total FROM pt
UNION ALL SELECT 'provenance', (SELECT sum(({_LINES})[bits + 1]) FROM (SELECT DISTINCT bits FROM pt)), count(*), NULL FROM pt
UNION ALL SELECT 'descriptions', {len(batch.QUANTITIES)} * count(*), count(*), sum(told) FROM pt
UNION ALL SELECT 'refusals', sum(nulls), count(*) FILTER (nulls > 0), NULL FROM pt
UNION ALL SELECT 'warnings', sum(warned), count(*) FILTER (warned > 0), NULL FROM pt
UNION ALL SELECT 'signals', sum(signalled), count(*), sum(apart) FROM pt
UNION ALL SELECT 'exclusions', sum(applied + typed), count(*) FILTER (applied + typed > 0), sum(seen) FROM pt)
"""
)


@query("batch_relations", COUNTS_SQL + "SELECT relation, rows::BIGINT AS rows, trials, round(total, 3) AS total FROM rc")
def batch_relations(spark, sf_dir):
    """Rows of each of the seven relations, the trials that have one, and a sum of its numbers. The trials are analysed in one pass."""
    d = analysed(spark, sf_dir)
    none = F.lit(None).cast("double")
    over = lambda name, field: F.aggregate(F.transform(name, lambda x: F.coalesce(x[field], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    counts = {
        "results": (F.lit(1), F.col("values.height_takeoff")),
        "provenance": (F.lit(0), none),
        "descriptions": (F.size("descriptions"), over("descriptions", "value")),
        "refusals": (F.size("refusals"), none),
        "warnings": (F.size("warnings"), none),
        "signals": (F.size("signals"), over("signals", "value")),
        "exclusions": (F.size("exclusions"), over("exclusions", "observed")),
    }
    rows = F.array(*[F.struct(F.lit(n).alias("relation"), k.cast("long").alias("k"), x.alias("x")) for n, (k, x) in counts.items()])
    told = d.select(F.inline(rows)).groupBy("relation").agg(F.sum("k").alias("rows"), F.count(F.when((F.col("k") > 0) | (F.col("relation") == "provenance"), 1)).alias("trials"), F.round(F.sum("x"), 3).alias("total"))
    lines = batch.provenance(d).agg(F.count("*").alias("lines"))
    return told.join(F.broadcast(lines)).select("relation", F.when(F.col("relation") == "provenance", F.col("lines")).otherwise(F.col("rows")).alias("rows"), "trials", "total")


#: What is known of the capture of the registered run.
CAPTURED = {"plate": "plate A", "sample_rate_hz": "100.0", "range_newtons": "10000", "zeroing": "before each session", "low_pass_hz": "none"}


@query(
    "bundle_round_trips",
    COUNTS_SQL + "SELECT kind, relation, rows::BIGINT AS rows, true AS same, true AS same_record FROM rc CROSS JOIN (SELECT unnest(['parquet', 'csv', 'json']) AS kind)",
)
def bundle_round_trips(spark, sf_dir):
    """All seven relations with the record of their run, written as Parquet, CSV and JSON envelopes and read back, bit for bit."""
    d = analysed(spark, sf_dir)
    relations = batch.relations(d)
    schemas = {n: x.schema for n, x in relations.items()}
    record = bundle.run_record(d, bundle.request_of(), CAPTURED)
    root = f"{store.shared_folder(spark)}/bundle-{uuid.uuid4().hex}"

    def told(kind: str, tables: dict, kept: bool) -> DataFrame:
        rows = [bundle.bits(x).withColumns({"kind": F.lit(kind), "relation": F.lit(n), "same_record": F.lit(kept)}) for n, x in tables.items()]
        return functools.reduce(DataFrame.unionByName, rows)

    read = []
    for kind in ("parquet", "csv", "json"):
        if kind == "json":
            bundle.to_envelopes(d, record).write.option("compression", "gzip").json(f"{root}/json")
            kept, again = bundle.from_envelopes(spark.read.schema("part long, envelope string").json(f"{root}/json"), schemas, f"{root}/parsed")
        else:
            bundle.write_bundle(relations, record, f"{root}/{kind}", kind)
            kept, again = bundle.read_bundle(spark, f"{root}/{kind}", schemas, kind)
        # seven rows stay of a format; its files go before the next one is written
        read.append(store.written(told(kind, again, kept == record), "bits"))
        store.discard(spark, f"{root}/{kind}")
    store.discard(spark, f"{root}/parsed")
    was = told("", relations, True).select("relation", F.struct("rows", "total", "mixed").alias("was"))
    now = functools.reduce(DataFrame.unionByName, read).withColumn("now", F.struct("rows", "total", "mixed"))
    return now.join(F.broadcast(was), "relation").select("kind", "relation", "was.rows", F.col("was").eqNullSafe(F.col("now")).alias("same"), "same_record")


RUNS = {"as_run": ({}, {}), "other_parameter": ({"onset.k": "6.0"}, {}), "other_plate": ({}, {"plate": "plate B"}), "unknown_filter": ({}, {"low_pass_hz": ""})}


def _record_sql() -> str:
    """Canonical text of each run's record: counts from the tables, the rest as it is stated."""
    counts = {"files_found": "trials", "trial_count": "trials", "computed_count": "computed", "refusal_count": "trials - computed", "partial_count": "partial", "trials_excluded": "excluded", "samples": "samples"}
    out = []
    for label, (changes, told) in RUNS.items():
        capture = CAPTURED | told
        whole = all(capture.values())
        fixed = {
            "files_unidentified": 0, "files_without_declared_suffix": 0, "gates_reporting": len(batch.GATES), "gates_applied": sum(x for *_, x in batch.GATES.values()),
            "request_digest": hashlib.sha256(bundle.canonical(bundle.request_of(changes)).encode()).hexdigest(), "rules_digest": batch.digest(batch.chain_lines(set(batch.MARKS))),
            **{f"capture.{k}": v for k, v in capture.items()}, "acquisition_complete": whole,
        }
        facts = counts | {"distinct_provenance_count": "len(ids)"} | {k: f"'{v}'" for k, v in fixed.items()}
        text = " || ';' || ".join(f"'{k}=' || ({v})" for k, v in sorted(facts.items()))
        print_ = f"sha256({text} || ';' || array_to_string(ids, ','))" if whole else "NULL"
        out.append(f"SELECT '{label}' AS run, trials AS trial_count, computed AS computed_count, trials - computed AS refusal_count, partial AS partial_count, excluded AS trials_excluded, len(ids) AS chains, {str(whole).lower()} AS acquisition_complete, {print_} AS run_fingerprint FROM ru")
    return " UNION ALL ".join(out)


@query(
    "run_record",
    PARTS_SQL
    + f""", ru AS (SELECT count(*) AS trials, count(*) FILTER (nulls < {len(batch.QUANTITIES)}) AS computed, count(*) FILTER (nulls > 0 AND nulls < {len(batch.QUANTITIES)}) AS partial, count(*) FILTER (applied > 0) AS excluded, sum(n)::BIGINT AS samples,
  list_sort(list(DISTINCT ({_IDS})[bits + 1])) AS ids FROM pt) """
    + _record_sql(),
)
def run_record(spark, sf_dir):
    """The record of the run as it was, with another parameter, on another plate, and on one whose filter nobody wrote down."""
    d, rows = analysed(spark, sf_dir), []
    for label, (changes, told) in RUNS.items():
        r = bundle.run_record(d, bundle.request_of(changes), CAPTURED | told)
        rows.append((label, *[r[k] for k in ("trial_count", "computed_count", "refusal_count", "partial_count", "trials_excluded", "distinct_provenance_count", "acquisition_complete", "run_fingerprint")]))
    return spark.createDataFrame(rows, "run string, trial_count long, computed_count long, refusal_count long, partial_count long, trials_excluded long, chains long, acquisition_complete boolean, run_fingerprint string")


@query(
    "resolve_construct",
    RESULTS_SQL
    + """, cd AS (SELECT 'jump_height' AS construct, unnest([CASE WHEN count(height_flight) > 0 THEN 'height_flight' END, CASE WHEN count(height_takeoff) > 0 THEN 'height_takeoff' END]) AS quantity FROM q
UNION ALL SELECT 'net_impulse', CASE WHEN count(net_impulse) > 0 THEN 'net_impulse' END FROM q UNION ALL SELECT 'peak_power', NULL)
SELECT construct, count(quantity) AS candidates, CASE WHEN count(quantity) = 1 THEN min(quantity) END AS resolved, CASE count(quantity) WHEN 0 THEN 'absent' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status,
  coalesce(string_agg(quantity, ',' ORDER BY quantity), '') AS names FROM cd GROUP BY construct""",
)
def resolve_construct(spark, sf_dir):
    """The column that measures a construct, by the rules in the run's provenance: one, two and no candidates."""
    asked = spark.createDataFrame([("net_impulse",), ("jump_height",), ("peak_power",)], "construct string")
    return batch.resolve(batch.provenance(analysed(spark, sf_dir)), asked)


@query(
    "unlike_conventions",
    RESULTS_SQL
    + """, ra AS (SELECT q.trial_id, q.subject, height_takeoff AS value, round(peak, 9) AS rank FROM q JOIN (SELECT trial_id, max(f) AS peak FROM m WHERE idx < takeoff GROUP BY trial_id) USING (trial_id) WHERE height_takeoff IS NOT NULL),
p AS (SELECT subject, stddev_samp(value) AS s, stddev_pop(value) AS ps, avg(value) AS m, stddev_samp(rank) AS sr, stddev_pop(rank) AS pr, avg(rank) AS mr FROM ra GROUP BY subject HAVING count(value) >= 2),
cv AS (SELECT avg(100 * s / m) AS v, avg(100 * sr / mr) AS rs, avg(100 * pr / mr) AS rp FROM p)
SELECT 'sample' AS first_dispersion, 'sample' AS second_dispersion, round(v - rs, 6) AS difference, 'ok' AS status FROM cv UNION ALL SELECT 'sample', 'population', NULL, 'unlike_conventions' FROM cv""",
)
def unlike_conventions(spark, sf_dir):
    """Difference of two coefficients of variation, where the rules that made them say that they count alike; else none."""
    d = store.written(ranked(spark, sf_dir).select("subject", "value", "rank"), "ranked")
    value = C.cv_with_rules(d, "subject", "value", "sample")
    out = None
    for dispersion in ("sample", "population"):
        row = C.cv_difference(value, C.cv_with_rules(d, "subject", "rank", dispersion))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("difference", F.round("difference", 6))


#: The registered grid: rules, a name and numbers of all three steps, in all their combinations.
GRID = [
    chains.Axis("onset", rules=("noise_relative", "share_of_weight")),
    chains.Axis("onset", parameter="back", numbers=(0, 3)),
    chains.Axis("onset", parameter="k", numbers=(3.0, 5.0, 8.0)),
    chains.Axis("onset", parameter="span", numbers=(1, 3, 5)),
    chains.Axis("weighing", rules=("fixed_window", "lowest_variance")),
    chains.Axis("weighing", parameter="centre", names=("mean", "median")),
    chains.Axis("takeoff", rules=("absolute_force", "descending", "longest_run")),
    chains.Axis("takeoff", parameter="threshold", numbers=(5.0, 10.0, 20.0)),
]

#: gv: value and code of every trial under every variant. Weighings are fm, fd (mean, median of the first second) and lv.
RULES_SQL = (
    f"WITH {SAMPLES_CTE}"
    + f""", md AS (SELECT trial_id, median(f) AS md FROM s GROUP BY trial_id),
sx AS (SELECT s.trial_id, idx, round(var_pop(f) OVER z, 9) AS v, min(f) OVER z <= 0.025e0 * md AS bad, count(*) OVER z AS c FROM s JOIN md USING (trial_id) WINDOW z AS (PARTITION BY s.trial_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
sb AS (SELECT trial_id, arg_min(idx, v * 1000e0 + idx * 1e-12) FILTER (NOT bad) AS start FROM sx WHERE c = 50 GROUP BY trial_id),
wt AS (SELECT trial_id, 'fm' AS wk, 100 AS e, avg(f) AS w, stddev_samp(f) AS sd FROM s WHERE idx < 100 GROUP BY trial_id
  UNION ALL SELECT trial_id, 'fd', 100, median(f), stddev_samp(f) FROM s WHERE idx < 100 GROUP BY trial_id
  UNION ALL SELECT trial_id, 'lv', any_value(start) + 50, avg(f), stddev_samp(f) FROM s JOIN sb USING (trial_id) WHERE idx BETWEEN start AND start + 49 GROUP BY trial_id),
ek AS (SELECT trial_id, wk, e FROM wt WHERE wk <> 'fd'),
wn AS (SELECT trial_id, idx, f, lag(f) OVER x AS pf, max(f) OVER (x ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS h3, count(*) OVER (x ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS c3, max(f) OVER (x ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS h5, count(*) OVER (x ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS c5 FROM s WINDOW x AS (PARTITION BY trial_id ORDER BY idx)),
th AS (SELECT unnest([5e0, 10e0, 20e0]) AS t),
ta AS (SELECT trial_id, wk, 'absolute_force' AS tr, t, min(idx) AS takeoff FROM wn JOIN ek USING (trial_id), th WHERE idx >= e AND c3 = 3 AND h3 < t GROUP BY ALL
  UNION ALL SELECT trial_id, wk, 'descending', t, min(idx) FROM wn JOIN ek USING (trial_id), th WHERE idx >= e AND c3 = 3 AND h3 < t AND pf >= t GROUP BY ALL),
lo AS (SELECT trial_id, wk, t, idx, idx - row_number() OVER (PARTITION BY trial_id, wk, t ORDER BY idx) AS island FROM wn JOIN ek USING (trial_id), th WHERE idx >= e AND f < t),
li AS (SELECT trial_id, wk, t, min(idx) AS a, count(*) AS size FROM lo GROUP BY trial_id, wk, t, island),
tk AS (SELECT * FROM ta UNION ALL SELECT trial_id, wk, 'longest_run', t, arg_min(a, a - size * 1000) FROM li GROUP BY ALL HAVING max(size) >= 3),
os AS (SELECT trial_id, wk, """
    + ", ".join(
        f"min(idx) FILTER ({hold} {level}) AS {name}{span}"
        for span, hold in ((1, "f <"), (3, "c3 = 3 AND h3 <"), (5, "c5 = 5 AND h5 <"))
        for name, level in (*((f"n{k}_", f"w - {k} * sd") for k in (3, 5, 8)), ("share_", "0.95e0 * w"))
    )
    + """ FROM wn JOIN wt USING (trial_id) WHERE idx >= e GROUP BY trial_id, wk),
cl AS (SELECT trial_id, list(cf ORDER BY idx) AS cs, list(f ORDER BY idx) AS fs FROM (SELECT trial_id, idx, f, sum(f) OVER (PARTITION BY trial_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS cf FROM s) GROUP BY trial_id),
vr AS (SELECT v, ['fixed_window', 'lowest_variance'][1 + v % 2] AS wr, ['mean', 'median'][1 + (v // 2) % 2] AS ce, ['absolute_force', 'descending', 'longest_run'][1 + (v // 4) % 3] AS tr, [5e0, 10e0, 20e0][1 + (v // 12) % 3] AS t,
  ['noise_relative', 'share_of_weight'][1 + (v // 36) % 2] AS onr, [0, 3][1 + (v // 72) % 2] AS back, [3, 5, 8][1 + (v // 144) % 3] AS k, [1, 3, 5][1 + (v // 432) % 3] AS span FROM range(1296) AS r(v)),
vw AS (SELECT *, CASE WHEN wr = 'lowest_variance' THEN 'lv' WHEN ce = 'median' THEN 'fd' ELSE 'fm' END AS wk, CASE WHEN wr = 'lowest_variance' THEN 'lv' ELSE 'fm' END AS ekk FROM vr),
ov AS (SELECT wt.trial_id, v, vw.ekk, tr, t, back, w, onr = 'noise_relative' AND (sd <= 0 OR w - k * sd <= 0) AS flat,
  CASE WHEN onr = 'share_of_weight' THEN CASE span WHEN 1 THEN share_1 WHEN 3 THEN share_3 ELSE share_5 END ELSE CASE span WHEN 1 THEN CASE k WHEN 3 THEN n3_1 WHEN 5 THEN n5_1 ELSE n8_1 END WHEN 3 THEN CASE k WHEN 3 THEN n3_3 WHEN 5 THEN n5_3 ELSE n8_3 END ELSE CASE k WHEN 3 THEN n3_5 WHEN 5 THEN n5_5 ELSE n8_5 END END END AS o
  FROM vw JOIN wt USING (wk) LEFT JOIN os USING (trial_id, wk)),
gc AS (SELECT ov.*, takeoff, CASE WHEN takeoff IS NULL THEN 2 WHEN flat THEN 3 WHEN o IS NULL OR o >= takeoff THEN 4 ELSE 0 END AS code FROM ov LEFT JOIN tk ON tk.trial_id = ov.trial_id AND tk.wk = ov.ekk AND tk.tr = ov.tr AND tk.t = ov.t),
gv AS (SELECT v, code, CASE WHEN code = 0 THEN ((cs[takeoff] - cs[greatest(o - back, 0) + 1] + fs[greatest(o - back, 0) + 1] - 0.5e0 * (fs[greatest(o - back, 0) + 1] + fs[takeoff]) - (takeoff - 1 - greatest(o - back, 0)) * w) * 0.01e0 / (w / """
    + str(G)
    + f""")) ** 2 / (2 * {G}) END AS value FROM gc JOIN cl USING (trial_id))
"""
)


@query(
    "rule_grid",
    RULES_SQL
    + """SELECT v::INT AS variant, 'weighing=' || any_value(wr) || ',weighing.centre=' || any_value(ce) || ',takeoff=' || any_value(tr) || ',takeoff.threshold=' || any_value(t) || ',onset=' || any_value(onr) || ',onset.back=' || any_value(back) || ',onset.k=' || any_value(k) || '.0,onset.span=' || any_value(span) AS label,
  count(*) AS trials, count(*) FILTER (code = 0) AS answered, 0::BIGINT AS no_weight, count(*) FILTER (code = 2) AS no_takeoff, count(*) FILTER (code = 3) AS collapsed_band, count(*) FILTER (code = 4) AS no_onset,
  round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS greatest, false AS capped FROM gv JOIN vr USING (v) GROUP BY v""",
)
def rule_grid(spark, sf_dir):
    """Every trial under all 1,296 chains of rules, weighing by takeoff by onset, with shared steps taken once; a row a variant."""
    variants, capped = chains.expand(GRID)
    d = chains.tally(trials(spark, sf_dir), variants)
    return d.withColumns({x: F.round(x, 6) for x in ("mean", "least", "greatest")}).withColumn("capped", F.lit(capped))


@query(
    "drift_ramp",
    BASE
    + f""", ra AS (SELECT *, (f - w) / (w / {G}) AS a, lag(f) OVER (PARTITION BY trial_id ORDER BY idx) AS pf FROM m WHERE onset < takeoff),
rv AS (SELECT *, sum(CASE WHEN idx > onset THEN 0.005e0 * (a + (pf - w) / (w / {G})) ELSE 0e0 END) OVER x AS vt, sum(CASE WHEN idx > onset THEN 0.01e0 * (pf - w) / (w / {G}) ELSE 0e0 END) OVER x AS vr FROM ra WHERE idx >= onset WINDOW x AS (PARTITION BY trial_id ORDER BY idx ROWS UNBOUNDED PRECEDING)),
rm AS (SELECT trial_id, any_value(onset) AS onset, any_value(takeoff) AS takeoff, max(vt) FILTER (idx = takeoff) AS goal, max(vt - vr) FILTER (idx = takeoff) AS residual,
  max(vr) FILTER (idx = onset) AS v0, max(vr) FILTER (idx = (onset + takeoff) // 2) AS v1, max(vr) FILTER (idx = takeoff) AS v2, max(vr) FILTER (idx = least(takeoff + 10, n - 1)) AS v3, max(vt) FILTER (idx = (onset + takeoff) // 2) AS t1 FROM rv GROUP BY trial_id)
SELECT lm.trial_id, round(residual, 6) AS residual, round(v0, 6) AS at_onset, round(v1 + residual * ((rm.onset + rm.takeoff) // 2 - rm.onset) / (rm.takeoff - rm.onset), 6) AS at_middle, round(v2 + residual, 6) AS at_takeoff,
  round(v3 + residual, 6) AS after_takeoff, round(goal, 6) AS by_impulse, round(t1, 6) AS trapezoid_at_middle FROM lm LEFT JOIN rm USING (trial_id)""",
)
def drift_ramp(spark, sf_dir):
    """Velocity by the sum of the left samples, put right by a line to the impulse's velocity at takeoff; by trapezoids nothing is left over."""
    d = L.place(trials(spark, sf_dir)).withColumn("n", F.size("force"))
    d = Q.ramp_to_impulse(d, "rectangle").withColumnsRenamed({"ramp_residual": "residual", "ramped": "left"})
    d = Q.ramp_to_impulse(d).withColumn("middle", F.floor((c.onset + c.takeoff) / 2).cast("int"))
    d = d.withColumn("goal", Q.impulse(c.force, c.onset, c.takeoff, c.weight))
    v = lambda i: A.at(F.col("left"), i)
    told = {
        "residual": F.col("residual"), "at_onset": v(c.onset), "at_middle": v(F.col("middle")), "at_takeoff": v(c.takeoff), "after_takeoff": v(F.least(c.takeoff + 10, F.col("n") - 1)),
        "by_impulse": F.when(c.ordered, F.col("goal") / (c.weight / G)), "trapezoid_at_middle": A.at(F.col("ramped"), F.col("middle")),
    }
    return d.select("trial_id", *rounded(**told))


#: Foot markers of a jump at takeoff and landing, and an athlete's stature, from columns of lines and customers.
MARKERS = (
    "SELECT l_orderkey AS trial_id, CASE WHEN l_linenumber = 1 THEN 'takeoff' ELSE 'landing' END AS event, 0.02e0 * l_tax AS knee_x, 0.4e0 + 0.001e0 * l_quantity AS knee_y, 0e0 AS ankle_x, 0e0 AS ankle_y, "
    "0.1e0 + 0.0004e0 * l_quantity AS toe_x, CASE WHEN l_linenumber = 1 THEN -0.11e0 - 0.2e0 * l_discount ELSE -0.02e0 - 0.2e0 * l_discount END AS toe_y FROM lineitem WHERE l_linenumber <= 2"
)
STATURES = "SELECT c_custkey % 20 AS subject, 1.5e0 + 0.02e0 * max(c_nationkey) AS stature FROM customer WHERE c_custkey % 20 < 18 GROUP BY 1"


def _bent(event: str) -> str:
    angle = "degrees(atan2(knee_y - ankle_y, knee_x - ankle_x)) - degrees(atan2(toe_y - ankle_y, toe_x - ankle_x)) - 90e0"
    return f"max({angle}) FILTER (event = '{event}')"


_RISE, _REACH = f"{Q.ANKLE_HEIGHT}e0 * stature", f"{Q.FOOT_LENGTH}e0 * {Q.AHEAD_OF_ANKLE}e0 * stature"
_LEANT = f"degrees(atan2({Q.ANKLE_HEIGHT}e0, {Q.FOOT_LENGTH}e0 * {Q.AHEAD_OF_ANKLE}e0))"


@query(
    "ankle_projection",
    RESULTS_SQL
    + f""", mk AS ({MARKERS}), su AS ({STATURES}), an AS (SELECT trial_id, {_bent("takeoff")} AS off, {_bent("landing")} AS bon, count(*) FILTER (event = 'takeoff') AS n1, count(*) FILTER (event = 'landing') AS n2 FROM mk GROUP BY trial_id),
sf AS (SELECT q.trial_id, q.flight_time AS ft, CASE WHEN n1 = 1 AND n2 = 1 THEN sqrt(({_RISE}) ** 2 + ({_REACH}) ** 2) * (sin(radians(off + {_LEANT})) - sin(radians(bon + {_LEANT}))) END AS shift, stature IS NULL AS unknown
  FROM q LEFT JOIN an USING (trial_id) LEFT JOIN su USING (subject))
SELECT trial_id, round(shift, 6) AS shift, round(CASE WHEN ft > 0 THEN {G} * ft ** 2 / 8 END, 6) AS uncorrected, round(CASE WHEN ft > 0 THEN {G} * ft ** 2 / 8 * (1 - 2 * shift / ({G} * ft ** 2)) ** 2 END, 6) AS corrected, unknown AS stature_missing FROM sf""",
)
def ankle_projection(spark, sf_dir):
    """Flight-time height less what the ankles give: segments of the foot from markers, projected at takeoff and landing."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    markers = spark.sql(MARKERS.replace("FROM lineitem", "FROM {lines}"), lines=table("lineitem"))
    statures = spark.sql(STATURES.replace("FROM customer", "FROM {people}"), people=table("customer"))
    d = Q.default_quantities(L.place(trials(spark, sf_dir))).select("trial_id", "subject", "flight_time")
    d = Q.ankle_shift(d, markers, statures).join(F.broadcast(statures.select("subject", F.lit(True).alias("known"))), "subject", "left")
    ft = F.col("flight_time")
    told = {"shift": F.col("ankle_shift"), "uncorrected": F.when(ft > 0, G * ft * ft / 8), "corrected": Q.height_with_shift(ft, F.col("ankle_shift"))}
    return d.select("trial_id", *rounded(**told), F.col("known").isNull().alias("stature_missing"))


@query(
    "column_facts",
    f"""WITH {SAMPLES_CTE}, z AS (SELECT trial_id, idx, 'force' AS name, CASE WHEN trial_id % 31 = 0 AND idx % 50 = 7 THEN 'nan'::DOUBLE ELSE f END AS x FROM s
UNION ALL SELECT trial_id, idx, 'time', idx / 100e0 + CASE WHEN trial_id % 7 = 0 THEN 0.05e0 * floor(idx / 9) ELSE 0e0 END FROM s),
d AS (SELECT *, x - lag(x) OVER (PARTITION BY trial_id, name ORDER BY idx) AS step FROM z),
g AS (SELECT trial_id, name, count(*) AS n, count(*) FILTER (isfinite(x)) AS finite, count(*) FILTER (x = 0) AS zeros, min(x) FILTER (isfinite(x)) AS least, max(x) FILTER (isfinite(x)) AS greatest, avg(x) FILTER (isfinite(x)) AS mean,
  median(x) FILTER (isfinite(x)) AS median, stddev_samp(x) FILTER (isfinite(x)) AS sd, bool_and(step > 0) AS up, max(step) - min(step) <= 1e-9 AS alike, avg(step) AS pace FROM d GROUP BY trial_id, name)
SELECT trial_id, name, n, finite, zeros, round(least, 6) AS least, round(greatest, 6) AS greatest, round(mean, 6) AS mean, round(median, 6) AS median, round(sd, 6) AS sd, finite = n AND up AS increasing, finite = n AND alike AS even,
  CASE WHEN finite = n AND up AND alike AND 1 / pace BETWEEN 20 AND 10000 THEN round(1 / pace, 6) END AS rate_hz FROM g""",
)
def column_facts(spark, sf_dir):
    """Each column of an export: finite and zero counts, spread, whether it rises by even steps, and the rate that implies; nothing is shuffled."""
    late = F.when(F.col("trial_id") % 7 == 0, F.lit(0.05)).otherwise(0.0)
    time = F.transform("force", lambda x, i: i / 100.0 + late * F.floor(i / 9))
    force = F.transform("force", lambda x, i: F.when((F.col("trial_id") % 31 == 0) & (i % 50 == 7), float("nan")).otherwise(x))
    d = A.settled(trials(spark, sf_dir).select("trial_id", "force"), time=time, bad=force)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), T.facts(F.col(x)).alias("x")) for n, x in (("force", "bad"), ("time", "time"))])
    d = d.select("trial_id", F.inline(rows)).select("trial_id", "name", "x.*")
    return d.withColumns({x: F.round(x, 6) for x in ("least", "greatest", "mean", "median", "sd", "rate_hz")})


@query(
    "jump_types",
    BASE
    + f""", dp AS (SELECT trial_id, any_value(w) AS w, any_value(w) - min(f) FILTER (idx < takeoff) AS depth FROM m GROUP BY trial_id), th AS (SELECT *, 250e0 * (w / {G} / 87.5e0) ** 0.667e0 AS scaled FROM dp)
SELECT trial_id, round(depth, 6) AS depth, round(scaled, 6) AS scaled_threshold, CASE WHEN depth > 250 THEN 'countermovement' WHEN depth <= 250 THEN 'squat' END AS by_fixed, CASE WHEN depth > scaled THEN 'countermovement' WHEN depth <= scaled THEN 'squat' END AS by_mass FROM th""",
)
def jump_types(spark, sf_dir):
    """Countermovement or squat jump by how far force falls under the weight before takeoff: over 250 N, or that scaled by mass. No type without a takeoff."""
    d = L.place(trials(spark, sf_dir)).withColumn("depth", c.weight - A.at(c.force, A.argmin(c.force, F.lit(0), c.takeoff)))
    d = d.withColumn("scaled", 250.0 * F.pow(c.weight / G / 87.5, F.lit(0.667)))
    named = lambda t: F.when(F.col("depth") > t, "countermovement").when(F.col("depth") <= t, "squat")
    return d.select("trial_id", *rounded(depth=F.col("depth"), scaled_threshold=F.col("scaled")), named(F.lit(250.0)).alias("by_fixed"), named(F.col("scaled")).alias("by_mass"))
