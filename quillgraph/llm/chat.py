"""Chat formatting with Spark expressions only: whole conversations to one training string and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, read

#: Fixed marks of the template. A block holds the adjacent turns of one role; inside texts and roles "\" becomes
#: "\b" and "<" becomes "\l", so that no text can hold a mark and every text comes back exactly; a line end in a
#: role becomes "\n".
OPEN, AFTER_ROLE, BETWEEN, CLOSE = "<|role|>", "\n", "<|next|>", "<|end|>\n"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv``, ``formatted`` and ``loss_runs``, the loss mask.

    Turns are ordered by turn (null first), then role and text, so ties have one order; repeated rows stay as turns.
    Running sums give each turn the byte of ``formatted`` (UTF-8) where its escaped text starts; turns are collected
    as structs and sorted by it. Adjacent turns of one role form a block whose turns a mark divides. Null role or
    text counts as empty; a null ``conv`` is a conversation of its own. ``loss_runs`` holds for each turn
    (start, bytes, trained); the bytes of the trained runs are what a model learns from. Every step is linear in the
    turns; a conversation is one output string, so its rows meet in one task. No rows give no rows; other columns
    play no part.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("_c"), F.col(turn).alias("t"), plain(role).alias("r"), plain(text).alias("x"))
    rows = rows.select("*", F.replace(escape(F.col("r")), F.lit("\n"), F.lit("\\n")).alias("er"), escape(F.col("x")).alias("ex"))
    order = Window.partitionBy("_c").orderBy(F.col("t").asc_nulls_first(), "r", "x")
    last = F.lag("r").over(order)
    rows = rows.select("_c", "r", "er", "ex", "t", "x", last.alias("last"), F.octet_length("ex").cast("long").alias("bytes"))
    begins = F.col("last").isNull() | (F.col("last") != F.col("r"))
    open_ = F.when(F.col("last").isNull(), 0).otherwise(len(CLOSE)) + len(OPEN + AFTER_ROLE) + F.octet_length("er")
    marks = F.when(begins, open_).otherwise(len(BETWEEN))
    end = F.sum(marks + F.col("bytes")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    said = F.struct(
        (end - F.col("bytes")).alias("start"), "bytes", (F.col("r") == TRAINED_ROLE).alias("trained"), begins.alias("begins"), F.when(begins, F.col("er")).alias("er"), "ex"
    )
    grouped = rows.select("_c", said.alias("_s")).groupBy("_c").agg(F.sort_array(F.collect_list("_s")).alias("_s"))

    def blocks(s: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.get(s, i)["begins"])
        until = lambda b, k: F.coalesce(F.get(b, k + 1), F.size(s))
        body = lambda b, i, k: F.array_join(F.transform(F.slice(s, i + 1, until(b, k) - i), lambda x: x["ex"]), BETWEEN)
        block = lambda b, i, k: F.concat(F.lit(OPEN), F.get(s, i)["er"], F.lit(AFTER_ROLE), body(b, i, k), F.lit(CLOSE))
        return let(begins, lambda b: F.transform(b, lambda i, k: block(b, i, k)))

    runs = F.transform("_s", lambda x: F.struct(x["start"].alias("start"), x["bytes"].alias("bytes"), x["trained"].alias("trained")))
    return grouped.select(F.col("_c").alias(conv), let(F.col("_s"), lambda s: F.array_join(blocks(s), "")).alias("formatted"), runs.alias("loss_runs"))


def under_mask(formatted: Column, runs: Column) -> Column:
    """All text under the loss mask: the bytes of the trained runs cut out of ``formatted``, unescaped, nothing between."""
    cut = lambda whole, r: F.substring(whole, (r["start"] + 1).cast("int"), r["bytes"].cast("int")).cast("string")
    trained = F.filter(runs, lambda r: r["trained"])
    return let(formatted.cast("binary"), lambda whole: F.array_join(F.transform(trained, lambda r: unescape(cut(whole, r))), ""))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), marks gone and texts unescaped."""
    quoted = lambda x: "\\Q" + x + "\\E"
    parts = F.filter(F.split(formatted, quoted(CLOSE)), lambda b: b != "")

    def turns(b: Column) -> Column:
        head = F.locate(AFTER_ROLE, b)
        role = unescape(F.replace(F.substr(b, F.lit(len(OPEN) + 1), head - len(OPEN) - 1), F.lit("\\n"), F.lit("\n")))
        texts = F.split(F.substr(b, head + len(AFTER_ROLE)), quoted(BETWEEN))
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(parts, turns))


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    """Per conversation digests of the turns read back from the output and of the text cut out by the loss mask.

    Null texts are empty, ties and repeated rows as in ``format_conversations``; an empty table gives conversation -7 alone.
    """
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role, F.lit("\\### Assistant: </turn> ok").alias("text"))
    out = format_conversations(rows.unionByName(extra))
    out = out.select("conv_id", "formatted", let(F.col("formatted"), read_back).alias("t"), under_mask(F.col("formatted"), F.col("loss_runs")).alias("loss"))
    digest = F.sha2(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256)
    loss = F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256")
    return out.select("conv_id", F.size("t").cast("long").alias("n_turns"), digest.alias("turns_sha256"), *loss, F.length("formatted").cast("long").alias("formatted_chars"))


#: 17: code points of the marks around a block's role and body; 8: those of the mark between two turns.
ORACLE = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) IS DISTINCT FROM role AS begins,
    2 * length(role) - length(replace(replace(role, '\', ''), '<', '')) AS role_chars,
    2 * length(text) - length(replace(replace(text, '\', ''), '<', '')) AS text_chars
  FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(text_chars + CASE WHEN begins THEN 17 + role_chars ELSE 8 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id""".replace("\\\\", "\\")
