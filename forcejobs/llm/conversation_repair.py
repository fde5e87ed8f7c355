"""Conversation structure repair: the cheapest edits, found as least whole numbers over a graph of rows and structure."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import written

#: White space of a text, and the marks that end one.
SPACES, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: A row's class is one letter: its role's initial and its first fault.
INITIALS, FAULTS = "sua-", "okay truncated blank duplicate".split()
OKAY, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Edit letters in ASCII order, so that their place here is their digit; 0 pads an audit's end.
LETTERS = "\0DIKR"
DIGIT = 3
#: Structure (s?(ua)+)?: state after each initial from each state; states 0 and 3 may end.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STEPS = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (NOTHING, ASSISTANT)
#: Rows of a conversation whose weights are one graph, and rows of one piece of it in a table.
GRAPH_ROWS, PIECE_ROWS = 256, 4096
ROLES = {"u": "user", "a": "assistant"}


@dataclass(frozen=True)
class Costs:
    """Cost of each edit; truncated is what an undeleted truncated row adds."""

    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def class_of(initial: str, fault: int) -> str:
    return chr(65 + 4 * (INITIALS.find(initial) if initial and initial in "sua" else 3) + fault)


def _edges(costs: Costs) -> dict[str, list[list[tuple[int, int, int]]]]:
    """Of each class and state: (state after, cost, digit) of every edit of such a row."""
    out = {}
    for i, initial in enumerate(INITIALS):
        for fault in range(4):
            own = []
            for state in range(4):
                edges = [(state, costs.delete, LETTERS.index("D"))]
                if fault < BLANK:
                    more = costs.truncated * (fault == TRUNCATED)
                    if (state, initial) in STEPS:
                        edges.append((STEPS[state, initial], costs.keep + more, LETTERS.index("K")))
                    edges += [(STEPS[state, r], costs.rerole + more, LETTERS.index("R")) for r in "ua" if (state, r) in STEPS]
                own.append(edges)
            out[chr(65 + 4 * i + fault)] = own
    return out


def graph(classes: str, costs: Costs, start: int = NOTHING, inserts: int = 0, edges: dict | None = None) -> tuple[list[int | None], int]:
    """Least weight of every state after all rows, from state start, and the digits of a weight that are an audit.

    A node is a row, a number of inserts and a state, so the place of the next letter is known. An edge weighs its cost
    times 8 ** width, plus its letter's digit at its fixed place. The least sum is the cheapest cost, and of equal costs
    the ASCII-least audit, as ends are padded with zeros. At most `inserts` rows are put in.
    """
    edges = edges or _edges(costs)
    width = len(classes) + inserts
    unit = DIGIT * width
    now: list[list[int | None]] = [[None] * 4 for _ in range(inserts + 1)]
    now[0][start] = 0
    for i in range(len(classes) + 1):
        for j in range(inserts):
            put = (costs.insert << unit) + (LETTERS.index("I") << DIGIT * (width - 1 - i - j))
            for state, w in enumerate(now[j]):
                for r in "ua":
                    after = STEPS.get((state, r))
                    if w is not None and after is not None and (now[j + 1][after] is None or w + put < now[j + 1][after]):
                        now[j + 1][after] = w + put
        if i == len(classes):
            break
        own, following = edges[classes[i]], [[None] * 4 for _ in range(inserts + 1)]
        for j, states in enumerate(now):
            place = DIGIT * (width - 1 - i - j)
            for state, w in enumerate(states):
                if w is not None:
                    for after, cost, digit in own[state]:
                        x = w + (cost << unit) + (digit << place)
                        if following[j][after] is None or x < following[j][after]:
                            following[j][after] = x
        now = following
    least = [min((w for w in column if w is not None), default=None) for column in zip(*now)]
    return least, width


def _joined(left: tuple[list, int], right: tuple[list, int]) -> tuple[list, int]:
    """Weights from each state to each other of two stretches of rows, one after the other."""
    (a, n), (b, m) = left, right
    mask = (1 << DIGIT * m) - 1
    out = [[None] * 4 for _ in range(4)]
    for s in range(4):
        for mid in range(4):
            for e in range(4):
                x, y = a[s][mid], b[mid][e]
                if x is not None and y is not None:
                    w = (x << DIGIT * m) + (y >> DIGIT * m << DIGIT * (n + m)) + (y & mask)
                    if out[s][e] is None or w < out[s][e]:
                        out[s][e] = w
    return out, n + m


def cheapest_edits(classes: str, costs: Costs = Costs()) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a conversation's rows, the ASCII-least of those.

    The graph holds as many inserts as the cost without them pays for. Where an insert costs more than two deletes none
    can pay: what is put in stands beside another row of its pair, and leaving out both takes one delete at most, or two
    where a system row then stands alone. A conversation of over GRAPH_ROWS rows then has a letter for each row, and is
    joined from stretches of so many rows, whose weights shift as they join.
    """
    edges = _edges(costs)
    if costs.insert > 2 * costs.delete and len(classes) > GRAPH_ROWS:
        parts = []
        for k in range(0, len(classes), GRAPH_ROWS):
            part = classes[k : k + GRAPH_ROWS]
            parts.append(([graph(part, costs, s, 0, edges)[0] for s in range(4)], len(part)))
        while len(parts) > 1:
            parts = [_joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        least, width = parts[0][0][NOTHING], parts[0][1]
    else:
        least, width = graph(classes, costs, edges=edges)
        inserts = (min(least[s] for s in FINAL if least[s] is not None) >> DIGIT * width) // max(costs.insert, 1)
        if inserts:
            least, width = graph(classes, costs, inserts=inserts, edges=edges)
    best = min(least[s] for s in FINAL if least[s] is not None)
    return best >> DIGIT * width, letters(best, width)


def letters(weight: int, width: int) -> str:
    """The audit in a weight's low digits."""
    octal = oct(weight & (1 << DIGIT * width) - 1)[2:].rjust(width, "0") if width else ""
    return octal.rstrip("0").translate({48 + k: x for k, x in enumerate(LETTERS)})


def repaired_roles(classes: str, audit: str) -> tuple[str, list[tuple[int, str]]]:
    """A letter for each row (its role's initial after the edits, = where it is kept as it is, - where it goes), and (row, initial) of inserts before a row."""
    out, put, state, row = [], [], NOTHING, 0
    for x in audit:
        turn = "a" if state == USER else "u"
        if x == "I":
            put.append((row, turn))
            state = STEPS[state, turn]
            continue
        if x == "K":
            state = STEPS[state, INITIALS[(ord(classes[row]) - 65) // 4]]
        elif x == "R":
            state = STEPS[state, turn]
        out.append({"K": "=", "R": turn, "D": "-"}[x])
        row += 1
    return "".join(out), put


def _answer(pieces: list[tuple], costs: Costs) -> tuple:
    """One conversation from its pieces (block, begin, classes, least, greatest, first, last turn, distinct turns)."""
    classes = "".join(p[2] for p in pieces)
    cost, audit = cheapest_edits(classes, costs)
    roles, put = repaired_roles(classes, audit)
    initials = [INITIALS[(ord(x) - 65) // 4] for x in classes]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    faults = [sum((ord(x) - 65) % 4 == f for x in classes) for f in (BLANK, DUPLICATE, TRUNCATED)]
    held = [p for p in pieces if p[7]]
    shared = sum(a[6] == b[5] for a, b in zip(held, held[1:]))
    span = max(p[4] for p in held) - min(p[3] for p in held) + 1 - sum(p[7] for p in held) + shared if held else 0
    parts, at = [], 0
    for k, (block, begin, own, *_) in enumerate(pieces):
        end = at + len(own) + (k == len(pieces) - 1)
        inside = [{"row": row - at, "role": r} for row, r in put if at <= row < end]
        parts.append({"block": block, "begin": begin, "roles": roles[at : at + len(own)], "put": inside})
        at += len(own)
    return (span, *faults, illegal, cost, audit, parts)


FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
PARTS = "parts array<struct<block: long, begin: long, roles: string, put: array<struct<row: long, role: string>>>>"


def _answers(costs: Costs, kind: pa.Schema):
    """For mapInArrow over pieces sorted by conversation and block: a row for each conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, out = [], None, []

        def table() -> pa.RecordBatch:
            cols = [pa.array([r[k] for r in out], t.type) for k, t in enumerate(kind)]
            return pa.record_batch(cols, schema=kind)

        for batch in batches:
            for c, *piece in zip(*(col.to_pylist() for col in batch.columns)):
                if held and c != key:
                    out.append((key, *_answer(held, costs)))
                    held = []
                key = c
                held.append(tuple(piece))
            if out:
                yield table()
                out = []
        if held:
            out.append((key, *_answer(held, costs)))
            yield table()

    return run


@dataclass
class Repair:
    """summary: a row for each conversation; rows: (conversation, at, seq, role, text, edit) as repaired, in order of at, seq."""

    summary: DataFrame
    rows: DataFrame


def repair_conversations(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    costs: Costs = Costs(),
) -> Repair:
    """Faults of every conversation and its cheapest repair to role initials (s?(ua)+)?.

    Rows are ordered by turn (null first), then role and the hash of the text, which settles ties. A row's first fault
    counts: blank (no character but white space), duplicate (role and text seen earlier), truncated (the last such character is not
    one of .!?). Blank and duplicate rows are deleted; the others are kept, given another role or deleted, and rows with
    empty text may be put in. summary holds gaps in the numbers of turns, counts of faults, illegal neighbours (initials
    other than su, ua, au), cost and audit (letters D I K R in order). Null conversations are one; null role and text
    count as one space. A conversation without rows has no row here. Other columns are not read.

    Rows of a long conversation lie in many parts: duplicates are found by grouping on text, and only one letter a row
    meets in one task, as the audit itself is one row of the result.
    """
    spark = turns.sparkSession
    c = F.col(conv_col).alias("c")
    text = F.coalesce(text_col, F.lit(" "))
    d = turns.select(c, F.col(turn_col).cast("long").alias("turn"), F.coalesce(role_col, F.lit(" ")).alias("role"), text.alias("text"))
    d = d.withColumn("h", F.md5("text"))
    order = [F.col("c").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "h"]
    placed = d.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()), "placed")
    firsts = placed.groupBy("c", "role", "h").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    trimmed = F.rtrim("text", F.lit(SPACES))
    initial = F.instr(F.lit("sua"), F.when(F.col("role") == "", "-").otherwise(F.substring("role", 1, 1)))
    initial = F.when(initial == 0, 3).otherwise(initial - 1)
    ended = F.instr(F.lit(ENDS), F.substring("t", -1, 1)) > 0
    marks = placed.select("c", "at", "turn", initial.alias("initial"), trimmed.alias("t"))
    marks = marks.select("c", "at", "turn", "initial", (F.col("t") == "").alias("blank"), (~ended).alias("cut"))
    marks = marks.join(firsts, "at", "left")
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(OKAY)
    # a block is a bounded stretch of one part of the order
    block = F.shiftright("at", 33) * (1 << 22) + F.floor(F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) / PIECE_ROWS)
    row = F.struct("at", F.char(65 + F.col("initial") * 4 + fault).alias("x"), "turn")
    pieces = marks.groupBy("c", block.alias("block")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    turn = F.filter(F.col("rows.turn"), lambda x: x.isNotNull())
    pieces = pieces.select(
        "c", "block", F.col("rows")[0]["at"].alias("begin"), F.array_join("rows.x", "").alias("classes"),
        F.array_min(turn).alias("least"), F.array_max(turn).alias("most"), F.get(turn, F.lit(0)).alias("head"),
        F.element_at(F.when(F.size(turn) > 0, turn), -1).alias("tail"), F.size(F.array_distinct(turn)).cast("long").alias("kinds"),
    )
    kind = d.schema["c"].dataType.simpleString()
    schema = f"c {kind}, {FIELDS}, {PARTS}"
    arrow = to_arrow_schema(spark.createDataFrame([], schema).schema)
    by_conversation = pieces.repartition("c").sortWithinPartitions("c", "block")
    answers = written(by_conversation.mapInArrow(_answers(costs, arrow), schema), "answers")
    part = answers.select("c", F.explode("parts").alias("p")).select("c", "p.block", "p.begin", "p.roles", "p.put")
    named = F.when(F.col("x") == "u", ROLES["u"]).when(F.col("x") == "a", ROLES["a"])
    lettered = placed.withColumn("block", block).alias("l").join(part.alias("r"), F.col("l.block").eqNullSafe(F.col("r.block")) & F.col("l.c").eqNullSafe(F.col("r.c")))
    lettered = lettered.select("l.c", "at", F.lit(1 << 40).alias("seq"), "role", "text", F.expr("substring(roles, int(at - begin) + 1, 1)").alias("x"))
    kept = lettered.where("x <> '-'").select(
        "c", "at", "seq", F.coalesce(named, "role").alias("role"), "text", F.when(F.col("x") == "=", "K").otherwise("R").alias("edit")
    )
    put = part.select("c", "begin", F.posexplode("put").alias("n", "x")).select(
        "c", (F.col("begin") + F.col("x.row")).alias("at"), F.col("n").cast("long").alias("seq"),
        F.when(F.col("x.role") == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text"), F.lit("I").alias("edit"),
    )
    rows = kept.unionByName(put) if costs.insert <= 2 * costs.delete else kept
    return Repair(answers.drop("parts").withColumnRenamed("c", conv_col), rows.withColumnRenamed("c", conv_col))


def row_hashes(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """sha256 of each conversation's `role:text` rows, joined by newlines, as its rows pass in order."""
    kind = rows.schema[conv_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                if state is None or c != key:
                    if state is not None:
                        out.append((key, state.hexdigest()))
                    key, state = c, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if out:
                yield pa.record_batch([pa.array([r[0] for r in out], batch.schema.field(0).type), pa.array([r[1] for r in out])], names=["c", "sha"])
                out = []
            typed = batch.schema.field(0).type
        if state is not None:
            yield pa.record_batch([pa.array([key], typed), pa.array([state.hexdigest()])], names=["c", "sha"])

    d = rows.repartition(conv_col).sortWithinPartitions(conv_col, "at", "seq").select(conv_col, "role", "text")
    return d.mapInArrow(run, f"c {kind}, sha string").select(F.col("c").alias(conv_col), F.col("sha").alias("repaired_sha256"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of the registered query: by crc32 of conv_id:turn modulo 20 some go, lose text or marks, come twice, or change role."""
    said = lambda k: F.coalesce(F.col(k).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(k == 1, "").when(k == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    role = F.when(k == 4, "user").otherwise(said("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(k == 3, 2).otherwise(1)))
    return turns.where(k != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def repair_digests(turns: DataFrame, repair: Repair) -> DataFrame:
    """The registered query's columns: every conversation of turns with its summary and the hash of its repaired rows."""
    ids = turns.select(F.col("conv_id").alias("k")).distinct()
    s, h = repair.summary, row_hashes(repair.rows)
    d = ids.join(s, F.col("k").eqNullSafe(s["conv_id"]), "left").drop("conv_id")
    d = d.join(h, F.col("k").eqNullSafe(h["conv_id"]), "left").drop("conv_id")
    zero = [F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return d.select(F.col("k").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), empty.alias("repaired_sha256"))


def _sql_fold() -> str:
    """DuckDB fold over a conversation's rows [initial, fault]: for each state the least `cost, audit` text; inserts never pay."""

    def more(x: str, cost: str, letter: str) -> str:
        return f"printf('%08d', left({x}, 8)::INT + {cost}) || substr({x}, 9) || '{letter}'"

    def edit(states: str, letter: str, cost: int, initial: str = "") -> str:
        allowed = "r[2] <> 'd'" + (f" AND r[1] = '{initial}'" if initial else "")
        best = more(f"least({states})", f"{cost} + CASE WHEN r[2] = 't' THEN 5 ELSE 0 END", letter)
        return f"CASE WHEN {allowed} THEN {best} END"

    gone = [more(f"x[{k}]", "2", "D") for k in (1, 2, 3, 4)]
    to_user = "x[1], x[2], x[4]"
    states = [
        gone[0],
        f"least({gone[1]}, {edit('x[1]', 'K', 0, 's')})",
        f"least({gone[2]}, {edit(to_user, 'K', 0, 'u')}, {edit(to_user, 'R', 1)})",
        f"least({gone[3]}, {edit('x[3]', 'K', 0, 'a')}, {edit('x[3]', 'R', 1)})",
    ]
    return f"list_reduce(rs, lambda x, r: [{', '.join(states)}], ['00000000', NULL, NULL, NULL])"


ORACLE_SQL = f"""
WITH RECURSIVE g(n, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT n, k + 1, xor(c >> 1, 3988292384 * (c & 1)) FROM g WHERE k < 8
), tab AS (SELECT list(c ORDER BY n) AS t FROM g WHERE k = 8
), src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), keyed AS (
  SELECT src.*, xor(list_reduce([ascii(k[i]) for i in range(1, len(k) + 1)], lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS m
  FROM src, tab
), d AS (
  SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN m = 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed WHERE m <> 0
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d
), f AS (
  SELECT *, left(role, 1) AS x, t = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
         right(t, 1) NOT IN ('.', '!', '?') AS cut, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS y
  FROM o
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
         count(*) FILTER (y || x NOT IN ('su', 'ua', 'au')) AS illegal,
         list([x, CASE WHEN blank OR again THEN 'd' WHEN cut THEN 't' ELSE 'k' END] ORDER BY i) AS rs
  FROM f GROUP BY conv_id
), w AS (SELECT *, {_sql_fold()} AS e FROM s
), b AS (SELECT * EXCLUDE (e, rs), left(least(e[1], e[4]), 8)::BIGINT AS cost, substr(least(e[1], e[4]), 9) AS audit FROM w
), kept AS (
  SELECT f.conv_id, role, text, i, audit[i] AS letter, x, row_number() OVER (PARTITION BY f.conv_id ORDER BY i) AS p
  FROM f JOIN b ON f.conv_id IS NOT DISTINCT FROM b.conv_id WHERE audit[i] <> 'D'
), named AS (
  SELECT *, max(CASE WHEN p = 1 AND letter = 'K' AND x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM kept
), hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (p - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i)) AS h
  FROM named GROUP BY conv_id
), ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN b ON ids.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN hashed ON ids.conv_id IS NOT DISTINCT FROM hashed.conv_id
"""
