"""Repair of conversations against every possible edit, its joined stretches, awkward rows and the SQL."""

import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from forcejobs.llm import conversation_repair as cr
from forcejobs.llm.conversation_repair import Costs, cheapest_edits, class_of, repair_conversations, repaired_roles, row_hashes
from forcejobs.llm.queries import oracle_sql, queries

CLASSES = [class_of(x, f) for x in "sua?" for f in range(4)]
SHAPE = re.compile(r"(s?(ua)+)?")


def by_trying(classes, costs, inserts):
    """Every edit of every row, with up to so many rows put in anywhere."""
    best = None
    options = []
    for x in classes:
        initial, fault = "sua-"[(ord(x) - 65) // 4], (ord(x) - 65) % 4
        own = [("D", costs.delete, "")]
        if fault < 2:
            more = costs.truncated * (fault == 1)
            own += [("K", costs.keep + more, initial)] + [("R", costs.rerole + more, r) for r in "ua"]
        options.append(own)
    for edits in itertools.product(*options):
        for k in range(inserts + 1):
            for gaps in itertools.combinations_with_replacement(range(len(classes) + 1), k):
                for roles in itertools.product("ua", repeat=k):
                    seq = []
                    for i in range(len(classes) + 1):
                        seq += [("I", costs.insert, r) for g, r in zip(gaps, roles) if g == i]
                        seq += edits[i : i + 1]
                    if SHAPE.fullmatch("".join(e[2] for e in seq)):
                        found = (sum(e[1] for e in seq), "".join(e[0] for e in seq))
                        best = min(best or found, found)
    return best


@pytest.mark.parametrize("costs, rows, inserts", [(Costs(), 4, 2), (Costs(insert=1), 3, 3), (Costs(0, 3, 2, 2, 5), 4, 2), (Costs(1, 1, 1, 1, 0), 3, 2)])
def test_cheapest_edits_are_those_of_trying_all(costs, rows, inserts):
    rng = random.Random(rows)
    for _ in range(60):
        classes = "".join(rng.choice(CLASSES[: rng.choice([9, 16])]) for _ in range(rng.randrange(rows + 1)))
        want = by_trying(classes, costs, inserts)
        got = cheapest_edits(classes, costs)
        if got[1].count("I") <= inserts:
            assert got == want
        else:
            assert got < want


def test_stretches_join_to_what_one_graph_finds(monkeypatch):
    rng = random.Random(2)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(cr, "GRAPH_ROWS", size)
        for _ in range(40):
            classes = "".join(rng.choice(CLASSES) for _ in range(rng.randrange(40)))
            least, width = cr.graph(classes, Costs())
            best = min(w for w in (least[0], least[3]) if w is not None)
            assert cheapest_edits(classes) == (best >> 3 * width, cr.letters(best, width))


def test_a_very_long_conversation():
    rng = random.Random(9)
    classes = "".join(rng.choice(CLASSES[:12]) for _ in range(60_000))
    cost, audit = cheapest_edits(classes)
    roles, put = repaired_roles(classes, audit)
    initials = "".join("sua-"[(ord(x) - 65) // 4] if r == "=" else r for x, r in zip(classes, roles) if r != "-")
    assert SHAPE.fullmatch(initials) and len(audit) == len(classes) and not put
    truncated = sum((ord(x) - 65) % 4 == 1 and r != "-" for x, r in zip(classes, roles))
    assert cost == audit.count("R") + 2 * audit.count("D") + 5 * truncated


ROWS = [
    (1, 0, "system", "be good."), (1, 1, "user", "hi?"), (1, 2, "assistant", "yes."), (1, 4, "user", "and"), (1, 5, "assistant", " \n"),
    (2, None, "user", "a."), (2, 1, "user", "a."), (2, 1, "assistant", "b!"),
    (3, None, None, None), (3, None, None, None),
    (None, 7, "tool", "x."), (None, 3, "user", "y."),
    (4, 0, "", "no end"), (5, 0, "user", "twice."), (5, 0, "user", "twice."), (5, 0, "assistant", "ok."),
]


@pytest.mark.parametrize("rows_in_piece", [1, 2, 4096])
def test_awkward_rows(spark, monkeypatch, rows_in_piece):
    monkeypatch.setattr(cr, "PIECE_ROWS", rows_in_piece)
    turns = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("at", F.lit("x")).withColumn("c", F.lit(1)).withColumn("audit", F.lit(2)).withColumn("block", F.lit(3))
    repair = repair_conversations(turns)
    got = {r.conv_id: tuple(r)[1:] for r in repair.summary.collect()}
    assert got == {
        1: (1, 1, 0, 1, 0, 4, "KKKDD"),
        2: (0, 0, 1, 0, 0, 2, "KKD"),
        3: (0, 2, 0, 0, 1, 4, "DD"),
        None: (3, 0, 0, 0, 1, 1, "KR"),
        4: (0, 0, 0, 1, 0, 2, "D"),
        5: (0, 0, 1, 0, 1, 4, "RRD"),
    }
    rows = [tuple(r) for r in repair.rows.orderBy("conv_id", "at", "seq").select("conv_id", "role", "text", "edit").collect()]
    assert [r for r in rows if r[0] in (None, 1, 2)] == [
        (None, "user", "y.", "K"), (None, "assistant", "x.", "R"),
        (1, "system", "be good.", "K"), (1, "user", "hi?", "K"), (1, "assistant", "yes.", "K"),
        (2, "user", "a.", "K"), (2, "assistant", "b!", "K"),
    ]
    hashes = {r[0]: r[1] for r in row_hashes(repair.rows).collect()}
    assert hashes[2] == hashlib.sha256(b"user:a.\nassistant:b!").hexdigest()
    assert repair_conversations(turns.where("1 = 0")).summary.collect() == []


def test_rows_are_put_in_where_that_is_cheapest(spark):
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c.")]
    repair = repair_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), costs=Costs(rerole=9, delete=9, insert=1))
    assert repair.summary.first().audit == "KIKK"
    found = [tuple(r) for r in repair.rows.orderBy("at", "seq").select("role", "text", "edit").collect()]
    assert found == [("user", "a.", "K"), ("assistant", "", "I"), ("user", "b.", "K"), ("assistant", "c.", "K")]


def test_query_equals_its_sql(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    got = queries()["op12_conversation_repair"](spark, sf).toPandas().sort_values("conv_id", ignore_index=True)
    want = con.execute(oracle_sql()["op12_conversation_repair"]).df().sort_values("conv_id", ignore_index=True)
    assert got.equals(want[list(got.columns)])


def test_query_equals_its_sql_on_nulls_and_dropped_conversations(spark, tmp_path):
    rows = [*ROWS, *((c, t, random.Random(c * 9 + t).choice(["user", "assistant", "system", "tool", None]), "x! y" if t % 3 else None) for c in range(10, 60) for t in range(c % 4))]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    names = ["conv_id", "audit", "cost", "gaps", "blank", "duplicate", "truncated", "illegal", "repaired_sha256"]
    got = queries()["op12_conversation_repair"](spark, str(tmp_path)).select(names).collect()
    want = con.execute(f"SELECT {', '.join(names)} FROM ({oracle_sql()['op12_conversation_repair']})").fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
