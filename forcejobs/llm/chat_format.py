"""Chat formatting by prefix-target expansion: an example for every assistant turn. SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Template of a turn: OPEN role newline text CLOSE. Role and text are escaped, so neither mark occurs inside them.
OPEN, CLOSE = "<s>", "</s>"
#: Escapes in the order they are applied; undone in reverse order. No control string is left without its first character.
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
ROLE_ESCAPES = [*ESCAPES, ("\n", "&#10;")]


def _mapped(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column) -> Column:
    return _mapped(c, ESCAPES)


def unescape(c: Column) -> Column:
    return _mapped(c, [(new, old) for old, new in reversed(ESCAPES)])


def format_examples(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    target_role: str = "assistant",
) -> DataFrame:
    """One row per trainable reply: conversation, example (from 0), target_turn, text, loss_start, loss_end.

    text holds every turn up to the reply in template form, and only code points loss_start <= i < loss_end, the reply's
    escaped text, are trainable. Turns after the last reply, and conversations without one, give one last example with
    an empty span and a null target_turn, so that no turn is lost. Turns are ordered by turn, then role and text, which
    settles ties and repeated rows; a null turn is first. Null role and text count as empty; null conversation ids form
    one conversation. An empty table gives no rows. Other input columns are not read. A conversation is one row of the
    work, as it is one text of the output.
    """
    d = turns.select(
        F.col(conv_col).alias("c"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(role_col, F.lit("")).alias("role"),
            F.coalesce(text_col, F.lit("")).alias("text"),
        ).alias("t"),
    )
    d = d.groupBy("c").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(OPEN), _mapped(t["role"], ROLE_ESCAPES), F.lit("\n"))
    n = F.size("ts")
    d = d.select(
        "c",
        "ts",
        F.transform("ts", lambda t: F.concat(head(t), escape(t["text"]), F.lit(CLOSE))).alias("f"),
        F.filter(F.transform("ts", lambda t, i: F.when((t["role"] == target_role) | (i == n - 1), i)), F.isnotnull).alias("at"),
    )
    d = d.select("c", "ts", "f", F.posexplode("at").alias("example", "i"))
    t = F.get("ts", F.col("i"))
    d = d.select(
        "c",
        "example",
        F.array_join(F.slice("f", 1, F.col("i") + 1), "").alias("text"),
        F.when(t["role"] == target_role, t["turn"]).alias("target_turn"),
        F.when(t["role"] == target_role, F.length(escape(t["text"]))).otherwise(0).alias("span"),
    )
    end = F.length("text") - len(CLOSE)
    return d.select(
        F.col("c").alias(conv_col),
        "example",
        "target_turn",
        "text",
        (end - F.col("span")).alias("loss_start"),
        end.alias("loss_end"),
    )


def parse_turns(text: Column) -> Column:
    """Array of struct(role, text), unescaped, of an example's text: the reverse of the template."""
    parts = F.filter(F.split(text, CLOSE), lambda x: x != "")
    body = lambda x: F.substring(x, len(OPEN) + 1, F.length(x))
    role = lambda x: F.substring_index(body(x), "\n", 1)
    return F.transform(
        parts,
        lambda x: F.struct(
            _mapped(role(x), [(new, old) for old, new in reversed(ROLE_ESCAPES)]).alias("role"),
            unescape(F.substring(body(x), F.length(role(x)) + 2, F.length(x))).alias("text"),
        ),
    )


def read_back(examples: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Per conversation, from the examples alone: its turns, the text under the loss masks, and digests of both."""
    d = examples.select(
        F.col(conv_col).alias("c"),
        "example",
        "text",
        unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))).alias("loss"),
    )
    d = d.groupBy("c").agg(
        F.max_by("text", "example").alias("whole"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    d = d.withColumn("turns", parse_turns(F.col("whole")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return d.select(
        F.col("c").alias(conv_col),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


#: The same digests, by SQL that never formats: lengths of the template are added up by a window.
ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), m AS (
  SELECT *, sum(8 + length(replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), chr(10), '&#10;'))
                  + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')))
              OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS chars,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars) FILTER (role = 'assistant' OR back = 1)::BIGINT AS formatted_chars
FROM m GROUP BY conv_id
"""
