"""Runs as a whole: folders of files, seven relations of one pass, bundles that are refused without their record, grids of chains."""

import itertools
import json
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from forcejobs.operators import batch, chains
from forcejobs.operators import cohort as C
from forcejobs.sources import bundle, folders
from forcejobs.sources.trials import trials

CAPTURE = {"plate": "p", "sample_rate_hz": "100", "range_newtons": "5000", "zeroing": "daily", "low_pass_hz": "none"}


def test_a_folder_keeps_every_file_as_a_row(spark, tmp_path):
    root = f"file://{tmp_path}/trials"
    held = {
        "a/AT1_5.force.txt": b"1.5\n2\n", "a/b/AT2_6.force.txt": b"3\nx\n", "a/AT_9.force.txt": b"4\n", "AT3_8.txt": b"5", "c/AT3_8.force.txt": b"6",
        "notes.csv": b"1", "AT4_1.force.txt": b"\xff\xfe1\n", "AT5_1.force.txt": b"", "odd name%20(1)/AT6_1.txt": b"7\n",
    }
    made = folders.write_files(spark.createDataFrame([(k, bytearray(v)) for k, v in held.items()], "path string, content binary"), root)
    read = folders.read_folder(spark, root, [".txt", ".force.txt"], "AT{subject}_{trial}")
    rows = {r.path: (r.suffix, r.status, r["values"]) for r in read.collect()}
    assert made == len(held) and rows == {
        "a/AT1_5.force.txt": (".force.txt", "ok", [1.5, 2.0]), "a/b/AT2_6.force.txt": (".force.txt", "bad_lines", [3.0]), "a/AT_9.force.txt": (".force.txt", "unidentified", None),
        "AT3_8.txt": (".txt", "duplicate", None), "c/AT3_8.force.txt": (".force.txt", "duplicate", None), "notes.csv": (None, "without_suffix", None),
        "AT4_1.force.txt": (".force.txt", "unreadable", None), "AT5_1.force.txt": (".force.txt", "unreadable", None), "odd name%20(1)/AT6_1.txt": (".txt", "ok", [7.0]),
    }
    assert folders.counts(read) == {"files_found": 8, "files_unidentified": 6, "files_without_declared_suffix": 1}
    with pytest.raises(ValueError, match="suffix"):
        folders.walk(spark, root, [], "AT{subject}_{trial}")


def test_a_run_from_files_equals_the_run_from_the_table(spark, sf_dir, tmp_path):
    root, d = f"file://{tmp_path}/trials", trials(spark, sf_dir).where("trial_id % 40 = 0")
    folders.write_files(d.select(F.format_string("%d/AT%d_%d.txt", "occasion", "subject", "trial_id").alias("path"), folders.text_of(F.col("force")).alias("content")), root)
    again = folders.trials_of(folders.read_folder(spark, root, [".txt"], "AT{subject}_{trial}"), "subject", "trial", 100.0)
    a, b = (sorted(map(str, batch.relations(batch.analyse(x))["results"].drop("source_path").collect())) for x in (d, again))
    assert len(a) > 5 and a == b


@pytest.fixture(scope="module")
def run(spark, sf_dir, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("run") / "analysed")
    d = trials(spark, sf_dir).where("trial_id % 30 = 0 OR trial_id % 190 = 0")
    odd = [(-1, 0, 100.0, None), (-2, 0, 100.0, []), (-3, 1, 100.0, [500.0] * 50), (-4, 1, 100.0, [float("nan")] * 200), (-5, 1, 100.0, [600.0] * 300)]
    odd = spark.createDataFrame([(i, s, 2000, hz, f) for i, s, hz, f in odd], d.schema)
    batch.analyse(d.unionByName(odd)).write.parquet(path)
    return spark.read.parquet(path)


def test_trials_without_answers_stay_as_rows_with_a_code_and_a_text(run):
    rows = {r.trial_id: r for r in run.where("trial_id < 0").collect()}
    assert {i: r.refusal_code for i, r in rows.items()} == {
        -1: "no_takeoff,no_weight", -2: "no_takeoff,no_weight", -3: "no_takeoff,no_weight", -4: "no_takeoff,no_weight", -5: "no_takeoff",
    }
    for r in rows.values():
        absent = {q for q, v in r["values"].asDict().items() if v is None}
        assert {x.quantity for x in r.refusals} == absent
        told = {x.quantity: x.account for x in r.descriptions}
        assert all(told[x.quantity] == x.message == batch.REFUSALS[x.code][2] for x in r.refusals)
        assert [x.ordinal for x in r.refusals] == list(range(len(absent)))
    assert [w.message for w in rows[-5].warnings] == [batch.WARNINGS["flat_stance"]]


def test_relations_tell_what_the_nested_rows_hold(run):
    tables, rows = batch.relations(run), run.collect()
    assert set(tables) == set(batch.RELATIONS)
    assert tables["results"].count() == len(rows)
    for name in ("descriptions", "refusals", "warnings", "signals", "exclusions"):
        assert tables[name].count() == sum(len(r[name]) for r in rows)
    told = {(r.provenance_id, r.quantity) for r in tables["provenance"].collect()}
    for r in rows:
        answered = {q for q, v in r["values"].asDict().items() if v is not None}
        assert {q for i, q in told if i == r.provenance_id} == answered
    assert len({i for i, _ in told}) == len({r.provenance_id for r in rows if any(v is not None for v in r["values"])})


def test_trials_are_read_once(spark, sf_dir):
    plan = batch.analyse(trials(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("hashpartitioning") == 0


def test_a_bundle_is_refused_without_its_record(spark, run, tmp_path):
    tables = batch.relations(run)
    schemas = {n: d.schema for n, d in tables.items()}
    record = bundle.run_record(run, bundle.request_of(), CAPTURE)
    with pytest.raises(bundle.Refused, match="record"):
        bundle.write_bundle(tables, None, f"{tmp_path}/none")
    with pytest.raises(bundle.Refused, match="lacks signals"):
        bundle.write_bundle({n: d for n, d in tables.items() if n != "signals"}, record, f"{tmp_path}/part")
    for kind in ("parquet", "csv"):
        bundle.write_bundle(tables, record, f"{tmp_path}/{kind}", kind)
        told, again = bundle.read_bundle(spark, f"{tmp_path}/{kind}", schemas, kind)
        assert told == record
        for name, d in tables.items():
            assert bundle.bits(d).collect() == bundle.bits(again[name]).collect()
    shutil.rmtree(tmp_path / "csv" / "run")
    with pytest.raises(bundle.Refused, match="no record"):
        bundle.read_bundle(spark, f"{tmp_path}/csv", schemas, "csv")
    tables["signals"].write.mode("overwrite").parquet(f"{tmp_path}/parquet/signals")
    with pytest.raises(bundle.Refused, match="without a record"):
        bundle.read_bundle(spark, f"{tmp_path}/parquet")
    other = bundle.run_record(run, bundle.request_of({"onset.k": "8.0"}), CAPTURE)
    d = tables["signals"]
    d.withMetadata(d.columns[0], {bundle.RUN_KEY: json.dumps(other, sort_keys=True)}).write.mode("overwrite").parquet(f"{tmp_path}/parquet/signals")
    with pytest.raises(bundle.Refused, match="more than one run"):
        bundle.read_bundle(spark, f"{tmp_path}/parquet")


def test_envelopes_hold_parts_of_a_run(spark, run):
    tables = batch.relations(run)
    schemas = {n: d.schema for n, d in tables.items()}
    record = bundle.run_record(run, bundle.request_of(), CAPTURE)
    sent = bundle.to_envelopes(run, record, part_trials=20).cache()
    assert sent.count() > 1 and all(set(json.loads(r.envelope)["ok"]) == {"run", *batch.RELATIONS} for r in sent.collect())
    told, again = bundle.from_envelopes(sent, schemas)
    assert told == record
    for name, d in tables.items():
        assert bundle.bits(d).collect() == bundle.bits(again[name]).collect(), name
    for bad in ('{"refusal": "no suffix"}', "not json"):
        with pytest.raises(bundle.Refused):
            bundle.from_envelopes(sent.unionByName(spark.createDataFrame([(99, bad)], sent.schema)), schemas)


def test_fingerprints_differ_by_a_parameter_and_are_withheld_where_the_capture_is_not_whole(run):
    print_of = lambda changes=None, profile=None, **told: bundle.run_record(run, bundle.request_of(changes), CAPTURE | told, profile=profile)["run_fingerprint"]
    base = print_of()
    assert base == print_of() == print_of(profile="our plate")
    assert len({base, print_of({"onset.k": "5.5"}), print_of(plate="q"), print_of(zeroing="never")}) == 4
    assert print_of(low_pass_hz="") is None
    with pytest.raises(bundle.Refused, match="onset.z"):
        bundle.request_of({"onset.z": "1"})
    record = bundle.run_record(run, bundle.request_of(), CAPTURE)
    assert bundle.canonical(record) == bundle.canonical(dict(reversed(record.items())))
    for name in ("files_found", "computed_count"):
        with pytest.raises(bundle.Refused):
            bundle.check_record(record | {name: record[name] + 1})


def test_a_column_is_resolved_by_its_rule(spark, run):
    asked = spark.createDataFrame([("net_impulse",), ("jump_height",), ("nothing",)], "construct string")
    got = {r.construct: (r.candidates, r.resolved, r.status) for r in batch.resolve(batch.provenance(run), asked).collect()}
    assert got == {"net_impulse": (1, "net_impulse", "ok"), "jump_height": (2, None, "ambiguous"), "nothing": (0, None, "absent")}
    table = batch.provenance(run)
    assert batch.convention(table, "height_flight", "weighing", "dispersion").first().value == "sample"
    other = table.withColumn("value", F.when((F.col("parameter") == "dispersion") & (F.col("quantity") == "height_flight"), F.col("provenance_id")).otherwise(F.col("value")))
    assert batch.convention(other, "net_impulse", "weighing", "dispersion").first().value == "sample"
    assert batch.convention(table, "height_flight", "onset", "k").first().value is None


def test_unlike_conventions_decline(spark):
    d = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0), (2, 2.5), (3, 9.0)], "s int, x double")
    a, b = (C.cv_with_rules(d, "s", "x", k) for k in ("sample", "population"))
    assert C.cv_difference(a, a).first().difference == 0.0
    r = C.cv_difference(a, b).first()
    assert r.difference is None and r.status == "unlike_conventions"


AXES = [
    chains.Axis("onset", parameter="k", numbers=(3.0, 5.0)),
    chains.Axis("takeoff", rules=tuple(chains.RULES["takeoff"])),
    chains.Axis("weighing", parameter="centre", names=("mean", "median")),
    chains.Axis("onset", parameter="back", numbers=(0, 3, 6)),
]


def test_a_grid_varies_the_first_axis_fastest_and_tells_its_cap():
    variants, capped = chains.expand(AXES)
    assert len(variants) == 36 and not capped
    want = [f"weighing.centre={c},takeoff={t},onset.k={k},onset.back={b}" for b, k, t, c in itertools.product((0, 3, 6), (3.0, 5.0), chains.RULES["takeoff"], ("mean", "median"))]
    assert [v.label for v in variants] == want
    some, capped = chains.expand(AXES, 10)
    assert some == variants[:10] and capped
    assert [v.label for v in chains.expand([])[0]] == ["baseline"]


@pytest.mark.parametrize(
    "axis, text",
    [
        (chains.Axis("landing", rules=("x",)), "no such step"),
        (chains.Axis("onset"), "one of the three"),
        (chains.Axis("onset", parameter="k", names=("a",), numbers=(1.0,)), "one of the three"),
        (chains.Axis("onset", rules=("guess",)), "no rule guess"),
        (chains.Axis("onset", parameter="threshold", numbers=(1.0,)), "no rule reads it"),
        (chains.Axis("weighing", parameter="centre", numbers=(1.0,)), "takes names"),
    ],
)
def test_axes_that_make_no_grid_are_refused(axis, text):
    with pytest.raises(chains.Refused, match=text):
        chains.expand([axis])


def test_shared_steps_are_taken_once_and_change_no_answer(spark, sf_dir):
    force = np.array([r.force for r in trials(spark, sf_dir).where("trial_id % 110 <> 0").orderBy("trial_id").limit(40).collect()])
    steady = np.full(40, 20.0)
    axes = [*AXES, chains.Axis("weighing", rules=tuple(chains.RULES["weighing"])), chains.Axis("onset", rules=tuple(chains.RULES["onset"]))]
    variants, _ = chains.expand(axes)
    tree = chains.Tree(force, 100.0, steady)
    for v in variants:
        alone = chains.Tree(force, 100.0, steady).height(v.chain)
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(tree.height(v.chain), alone))
    # 3 weighings; 3 takeoffs after each of 2 windows; for each weighing 2 bands and 1 share
    assert len(variants) == 144 and tree.taken == 3 + 3 * 2 + 3 * 3


def test_grids_of_awkward_traces(spark):
    rows = [(1, 0, 100.0, None), (2, 0, 100.0, []), (3, 0, 100.0, [500.0] * 30), (4, 0, 100.0, [float("nan")] * 150), (5, 0, 100.0, [600.0, 601.0] * 75 + [100.0] * 20 + [0.0] * 20)]
    d = spark.createDataFrame(rows, "trial_id long, subject long, sample_rate_hz double, force array<double>")
    variants, _ = chains.expand([chains.Axis("takeoff", rules=tuple(chains.RULES["takeoff"]))])
    got = {r.trial_id: (r["values"], r.codes) for r in chains.heights(d, variants).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [([None] * 3, [1] * 3)] * 4
    assert got[5][1] == [0, 0, 0] and all(v > 0 for v in got[5][0])
    assert chains.by_variant(chains.heights(d.where("trial_id = 0"), variants), variants).count() == 0
