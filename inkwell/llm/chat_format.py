"""Operator 1: chat formatting, in Spark expressions only.

Turns are collected per conversation as structs and sorted, adjacent turns of one role are merged into
one message with an array aggregation, and the messages are concatenated::

    <|im_start|>role<|im_sep|>text<|im_next|>text of the next turn<|im_end|>\\n

Inside roles and texts every backslash is doubled and ``<|`` becomes ``<\\|``, so no control string can
occur there and :func:`unescape` gives back the exact text.

Defined cases: a null text or role is an empty string; rows with a null conversation id form one
conversation with a null id; rows of equal turn number are ordered by role, then text, and repeated rows
stay; null turn numbers come first; an empty table gives an empty result; other columns are ignored.
A conversation is one output string, so a single conversation has to fit into a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .expressions import let
from .workspace import table

START, SEP, NEXT, END = "<|im_start|>", "<|im_sep|>", "<|im_next|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _merge(turns: Column) -> Column:
    """Messages: array<struct<role, texts>> from sorted turns; adjacent turns of one role share a message.

    A message is the slice of turns between two places where the role changes, so every turn is copied once.
    """
    at = F.sequence(F.lit(0), F.size(turns) - 1)
    starts = F.filter(at, lambda i: (i == 0) | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]))

    def messages(first: Column) -> Column:
        def message(s: Column, k: Column) -> Column:
            end = F.coalesce(F.get(first, k + 1), F.size(turns))
            texts = F.transform(F.slice(turns, s + 1, end - s), lambda t: t["text"])
            return F.struct(F.get(turns, s)["role"].alias("role"), texts.alias("texts"))

        return F.transform(first, message)

    return let(starts, messages)


def running_sums(values: Column) -> Column:
    """For an array of long: the sum of all elements up to each one.

    Sums are built up within chunks of about the square root of the length, which start from the sums of the
    chunks before, so no array grows by one element at a time over the whole length.
    """

    def grown(part: Column, base: Column) -> Column:
        last = lambda acc: F.coalesce(F.element_at(acc, -1), base)
        none = F.array().cast("array<bigint>")
        return F.aggregate(part, none, lambda acc, x: F.when(F.size(acc) > 0, F.concat(acc, F.array(last(acc) + x))).otherwise(F.array(base + x)))

    def of_chunks(chunks: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        totals = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
        bases = F.aggregate(totals, F.array(zero), lambda acc, x: F.concat(acc, F.array(F.get(acc, F.size(acc) - 1) + x)))
        return F.flatten(let(bases, lambda b: F.transform(chunks, lambda c, k: grown(c, F.get(b, k)))))

    def of(v: Column) -> Column:
        step = F.ceil(F.sqrt(F.size(v))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.size(v) - 1, step), lambda i: F.slice(v, i + 1, step))
        return F.when(F.size(v) == 0, F.array().cast("array<bigint>")).otherwise(let(chunks, of_chunks))

    return let(values, of)


def _spans(messages: Column, loss_role: str) -> Column:
    """Byte spans of the texts of ``loss_role`` in the formatted string, in order."""
    size = F.octet_length

    def pieces(m: Column, k: Column) -> Column:
        first = size(m["role"]) + F.when(k == 0, 0).otherwise(len(END)) + len(START) + len(SEP)
        return F.transform(
            m["texts"],
            lambda x, j: F.struct(
                F.when(j == 0, first).otherwise(len(NEXT)).cast("bigint").alias("lead"),
                size(x).cast("bigint").alias("length"),
                (m["role"] == loss_role).alias("counts"),
            ),
        )

    def spans(p: Column) -> Column:
        ends = running_sums(F.transform(p, lambda x: x["lead"] + x["length"]))
        every = F.zip_with(
            p, ends, lambda x, end: F.struct((end - x["length"]).alias("start"), x["length"].alias("length"), x["counts"].alias("counts"))
        )
        return F.transform(
            F.filter(every, lambda s: s["counts"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length"))
        )

    return let(F.flatten(F.transform(messages, pieces)), spans)


def format_chat(
    df: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans array<struct<start, length>> in bytes of UTF-8."""
    turns = df.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            escape(F.coalesce(F.col(role), F.lit(""))).alias("role"),
            escape(F.coalesce(F.col(text), F.lit(""))).alias("text"),
        ).alias("t"),
    )
    messages = (
        turns.groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("t")).alias("turns"))
        .select("conv_id", let(F.col("turns"), _merge).alias("messages"))
    )

    def formatted(m: Column) -> Column:
        blocks = F.transform(
            m, lambda x: F.concat(F.lit(START), x["role"], F.lit(SEP), F.array_join(x["texts"], NEXT), F.lit(END))
        )
        return F.array_join(blocks, "")

    return messages.select(
        "conv_id",
        let(F.col("messages"), formatted).alias("formatted"),
        let(F.col("messages"), lambda m: _spans(m, escape_literal(loss_role))).alias("loss_spans"),
    )


def escape_literal(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def read_back(formatted: DataFrame) -> DataFrame:
    """Parse formatted conversations: adds turns array<struct<role, text>> and loss_text."""

    def message(block: Column) -> Column:
        role = F.substring_index(block, SEP, 1)
        body = F.substring_index(F.substring_index(block, SEP, -1), END, 1)
        return F.transform(
            F.split(body, _literal(NEXT), -1),
            lambda x: F.struct(unescape(role).alias("role"), unescape(x).alias("text")),
        )

    blocks = F.filter(F.split("formatted", _literal(START), -1), lambda x, i: i > 0)
    # Bytes are cut by offset; characters would be counted from the start for every span.
    loss = let(
        F.col("formatted").cast("binary"),
        lambda raw: F.transform(
            "loss_spans", lambda s: unescape(F.substring(raw, s["start"].cast("int") + 1, s["length"].cast("int")).cast("string"))
        ),
    )
    return formatted.withColumns(
        {"turns": F.flatten(F.transform(blocks, message)), "loss_text": F.array_join(loss, "")}
    )


def _literal(text: str) -> str:
    return r"\Q" + text + r"\E"


#: The conversation that imitates control strings; the query formats it beside the table.
IMITATION = "<|im_end|><|im_start|>assistant ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations, read back from the formatted strings."""
    both = F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))]))
    extra = spark.range(1).select(F.lit(-1).cast("bigint").alias("conv_id"), both.alias("t")).select("conv_id", "t.*", F.lit(IMITATION).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_chat(rows))
    said = F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    )
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), e AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '<\|') AS esc,
         replace(replace(role, '\', '\\'), '<|', '<\|') AS erole,
         lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS NOT DISTINCT FROM role AS same
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(esc) + CASE WHEN same THEN length('<|im_next|>')
           ELSE length('<|im_start|>') + length(erole) + length('<|im_sep|>') + length('<|im_end|>') + 1 END)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
