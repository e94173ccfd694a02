"""Chat formatting: one training example for each assistant turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A turn is written <|role|>text<|end|>.  Inside roles and texts these
#: characters, with which control strings begin or end, are percent-escaped.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("|", "%7C"))
OPEN, CLOSE, END = "<|", "|>", "<|end|>"
TRAINABLE = "assistant"


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def prefix_target_examples(turns: DataFrame) -> DataFrame:
    """Explode every assistant turn into an example with all turns before it.

    ``turns`` has conv_id, turn, role and text; other columns, whatever their
    names, are ignored.
    Turns are ordered by (turn, role, text), nulls first, so ties and repeated
    rows have one defined place.  A null role or text is an empty one.  A null
    conv_id is a conversation of its own, and an empty table gives an empty
    result.  A conversation that does not end
    with an assistant turn also gives one last example without a target, so
    that no turn is lost.

    Returns conv_id, example (from 1 within a conversation), last (whether it
    holds the whole conversation), formatted, and loss_start and loss_length:
    the code points of ``formatted`` that are trained on (length 0: none).
    An example holds its context, so memory is that of one conversation.
    """
    blank = F.lit("")
    by_conv = (
        turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
        .select(
            "conv_id",
            F.transform("t", lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(CLOSE), escape(x["text"]), F.lit(END))).alias("written"),
            F.transform("t", lambda x: F.length(escape(x["text"]))).alias("chars"),
            F.filter(F.transform("t", lambda x, i: F.when((x["role"] == TRAINABLE) | (i == F.size("t") - 1), F.struct((i + 1).alias("k"), (x["role"] == TRAINABLE).alias("trained")))), lambda x: x.isNotNull()).alias("ends"),
        )
    )
    each = by_conv.select("conv_id", "written", "chars", F.posexplode("ends").alias("at", "end"))
    n = F.col("end.k")
    text = each.select(
        "conv_id",
        (F.col("at") + 1).alias("example"),
        (n == F.size("written")).alias("last"),
        F.array_join(F.slice("written", F.lit(1), n), "").alias("formatted"),
        F.when(F.col("end.trained"), F.element_at("chars", n)).otherwise(0).alias("loss_length"),
    )
    return text.withColumn("loss_start", F.length("formatted") - len(END) - F.col("loss_length"))


def read_back(examples: DataFrame) -> DataFrame:
    """Parse formatted examples into digests of what they hold.

    The turns are parsed from each conversation's last example, the trained
    texts from the loss span of every example.
    """
    written = F.split(F.expr(f"left(formatted, length(formatted) - {len(END)})"), r"<\|end\|>", -1)

    def turn(x: Column) -> Column:
        at = F.instr(x, CLOSE)
        role = F.substring(x, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(x, at + len(CLOSE), F.length(x))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    parsed = examples.select(
        "conv_id",
        "example",
        F.length("formatted").cast("long").alias("chars"),
        F.when(F.col("last"), F.size(written)).alias("n"),
        F.when(F.col("last"), F.sha2(F.array_join(F.transform(written, turn), ""), 256)).alias("turns"),
        unescape(F.expr("substring(formatted, loss_start + 1, loss_length)")).alias("loss"),
    )
    loss = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    return parsed.groupBy("conv_id").agg(
        F.max("n").cast("long").alias("n_turns"),
        F.max("turns").alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.sum("chars").alias("formatted_chars"),
    )


def _length_escaped(c: str) -> str:
    for raw, _ in ESCAPES:
        c = f"replace({c}, '{raw}', '{raw}__')"
    return f"length({c})"


ORACLE_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum({len(OPEN + CLOSE + END)} + {_length_escaped('role')} + {_length_escaped('text')}) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(upto) FILTER (role = 'assistant' OR k = n) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""
