r"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context,
and only that reply, up to its closing mark, under the loss mask. Turns after the last reply are kept in one
more example without a target, so that the output holds every turn of every conversation.

A turn is written as ``### role: text </turn>`` and a newline. Inside texts every backslash is
doubled, and one is put before each ``#`` and ``</turn>``, so that no text can open or close a turn;
``unescape`` takes this back exactly. Roles are URL-encoded, which leaves plain names as they are.

A conversation is one row here, as its digest is one of its whole text; its examples grow
with the square of its turns, which is what the expansion asks for. Turns are sorted inside
the row, not by the order in which a shuffle brings them.

Defined results: a null text or role counts as empty; turns are ordered by number, null first, and rows of one
number by role and text, so repeated rows are turns of their own; null conversation ids are one
conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hubwright.llm.common import hex_digest, or_empty, table

TARGET_ROLE = "assistant"
# Fixed values of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"


def escape(text: Column) -> Column:
    r"""``\`` to ``\\``, then every ``#`` and every ``</turn>`` gets a backslash before it."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    marked = F.replace(doubled, F.lit("#"), F.lit("\\#"))
    return F.replace(marked, F.lit("</turn>"), F.lit("\\</turn>"))


def unescape(text: Column) -> Column:
    """A backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), F.url_encode(role), F.lit(MIDDLE), escape(text), F.lit(CLOSE))


def examples(conversations: DataFrame, target_role: str = TARGET_ROLE) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end: the mask is the code points [loss_start, loss_end) of text, or empty.

    ``target`` is the number of the trainable turn, null in the example without one.
    """
    turn = F.struct("turn", or_empty("role").alias("role"), or_empty("text").alias("text"))
    whole = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select(
        "conv_id",
        F.transform("turns", lambda t: render(t["role"], t["text"])).alias("rendered"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"),
        F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.get("turns", i - 1)["role"] == target_role).alias("targets"),
    )
    n = F.size("rendered")
    # positions (1-based) of the last turn of each example; the trailing one has no target
    last = F.when(F.array_contains("targets", n), F.col("targets")).otherwise(F.array_append("targets", n))
    each = whole.select("conv_id", "rendered", "sizes", "targets", F.posexplode(last).alias("example", "last"))
    text = F.array_join(F.slice("rendered", 1, F.col("last")), "")
    trained = F.array_contains("targets", F.col("last"))
    made = each.select(
        "conv_id",
        "example",
        F.when(trained, F.col("last") - 1).alias("target"),
        text.alias("text"),
        F.get("sizes", F.col("last") - 1).alias("size"),
        trained.alias("trained"),
    )
    end = F.length("text") - len(CLOSE)
    return made.select(
        "conv_id",
        F.col("example").cast("long").alias("example"),
        F.col("target").cast("long").alias("target"),
        "text",
        F.when(F.col("trained"), end - F.col("size")).otherwise(0).alias("loss_start"),
        F.when(F.col("trained"), end).otherwise(0).alias("loss_end"),
    )


def read_turns(text: Column) -> Column:
    """The turns of a formatted text, read back: array of role and text."""
    # inside a text the closing mark always has a backslash before it, so the plain one is the template's
    parts = F.split(text, CLOSE)
    parts = F.slice(parts, 1, F.size(parts) - 1)
    head = rf"\A{OPEN}([^:]*){MIDDLE}"
    return F.transform(
        parts,
        lambda p: F.struct(
            F.url_decode(F.regexp_extract(p, head, 1)).alias("role"), unescape(F.regexp_replace(p, head, "")).alias("text")
        ),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: its turns (from the longest example) and the text under the mask."""
    masked = unescape(F.expr("substring(text, loss_start + 1, loss_end - loss_start)"))
    return formatted.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", masked.alias("loss")))), lambda x: x["loss"]), "").alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
    ).select("conv_id", read_turns(F.col("longest")).alias("turns"), "loss", "formatted_chars")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    back = read_back(examples(turns.unionByName(extra)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        hex_digest(said).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        hex_digest(F.col("loss")).alias("loss_sha256"),
        "formatted_chars",
    )


OP7_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>')) + length(role) + 15 AS chars FROM turns
), upto AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY turn) AS so_far,
         turn = max(turn) OVER (PARTITION BY conv_id) AS is_last
  FROM sized
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(so_far) FILTER (role = 'assistant' OR is_last) AS BIGINT) AS formatted_chars
FROM upto GROUP BY conv_id
"""
