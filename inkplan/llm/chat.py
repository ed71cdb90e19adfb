"""Chat formatting with a grammar round trip, in DataFrame functions alone.

A conversation is rendered as

    <s:LEVEL> turn turn ...        turn: [INST role]\\n text [/INST]   or, for the assistant,   [OUT]\\n text </s>

(without the blanks shown here; role is percent-encoded). The rendered text is parsed again with the grammar alone and
the turns found are compared with the source. Texts stand as they are, at level 0, only where none of a conversation holds
a control string and the parse gives the source; every other conversation is rendered at level 1: backslashes are doubled
and one is put inside each control string. If that differed too, the query would fail rather than return it.

The loss mask is a list of spans of the rendered text, one for each text of the assistant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
# What begins like a mark of the template: [INST, [/INST], [OUT], <s:, </s>
_CONTROL = r"\[(?=/?INST|OUT\])|<(?=/s>|s:)"
_TURN = r"(?s)\[INST [^\]]*\]\n.*?\[/INST\]|\[OUT\]\n.*?</s>"


def _escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def _plain(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def rendered(turns: Column, level: int) -> Column:
    """turns: array of (role, text), neither null."""
    text = (lambda t: _escaped(t["text"])) if level else (lambda t: t["text"])
    one = lambda t: F.when(t["role"] == ASSISTANT, F.concat(F.lit("[OUT]\n"), text(t), F.lit("</s>"))).otherwise(F.concat(F.lit("[INST "), F.url_encode(t["role"]), F.lit("]\n"), text(t), F.lit("[/INST]")))
    return F.concat(F.lit(f"<s:{level}>"), F.array_join(F.transform(turns, one), ""))


def parsed(text: Column) -> Column:
    """The turns that the grammar finds: array of (role, text); null if it doesn't cover the whole text."""
    body, escaped = F.regexp_replace(text, r"^<s:\d+>", ""), F.regexp_extract(text, r"^<s:(\d+)>", 1) != "0"
    parts = F.regexp_extract_all(body, F.lit(_TURN), F.lit(0))
    inside = lambda t: F.when(escaped, _plain(t)).otherwise(t)

    def turn(p: Column) -> Column:
        at = F.instr(p, "]")
        given = F.url_decode(p.substr(F.lit(7), at - 7))
        return F.when(
            p.startswith("[OUT]\n"), F.struct(F.lit(ASSISTANT).alias("role"), inside(p.substr(F.lit(7), F.length(p) - 10)).alias("text"))
        ).otherwise(F.struct(given.alias("role"), inside(p.substr(at + 2, F.length(p) - at - 8)).alias("text")))

    return F.when(text.rlike(r"^<s:\d+>") & (F.array_join(parts, "") == body), F.transform(parts, turn))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role and text, read back from formatted), loss (array of first and past: code points of formatted).

    conversations: conv_id, turn, role, text; other columns, whatever their names, are ignored. Turns are in the order of turn
    (null first); ties go by role, then text, and repeated rows are turns of their own. A null role or text counts as
    empty. Rows with a null conv_id are one conversation. A conversation is one value and is put together in one task,
    its texts whole however long; an empty table gives no rows.
    """
    source = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    rows = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(source.alias("source"))
    rows = rows.withColumn("raw", ~F.exists("source", lambda t: t["text"].rlike(_CONTROL)))
    rows = rows.withColumn("f0", F.when(F.col("raw"), rendered(F.col("source"), 0))).withColumn("t0", parsed(F.col("f0"))).withColumn("same", F.col("raw") & F.col("t0").eqNullSafe(F.col("source")))
    rows = rows.withColumn("formatted", F.when(F.col("same"), F.col("f0")).otherwise(rendered(F.col("source"), 1)))
    rows = rows.withColumn("turns", F.when(F.col("same"), F.col("t0")).otherwise(parsed(F.col("formatted"))))
    lost = F.raise_error(F.concat(F.lit("conversation is not read back as written: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    turns = F.when(F.col("turns").eqNullSafe(F.col("source")), F.col("turns")).otherwise(lost.cast("array<struct<role:string,text:string>>"))
    return rows.select("conv_id", "formatted", turns.alias("turns"), loss_spans(F.col("formatted")).alias("loss"))


def loss_spans(text: Column) -> Column:
    """The assistant's texts as spans of a rendered conversation: array of first and past, code points from 0."""
    head = F.length(F.regexp_extract(text, r"^<s:\d+>", 0))
    parts = F.regexp_extract_all(F.regexp_replace(text, r"^<s:\d+>", ""), F.lit(_TURN), F.lit(0))
    lengths = F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.startswith("[OUT]\n").alias("loss")))
    start = F.struct(head.alias("at"), F.array().cast("array<struct<first:int,past:int>>").alias("spans"))

    def step(s: Column, t: Column) -> Column:
        span = F.array(F.struct((s["at"] + 6).alias("first"), (s["at"] + t["n"] - 4).alias("past")))
        return F.struct((s["at"] + t["n"]).alias("at"), F.when(t["loss"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    return F.aggregate(lengths, start, step, lambda s: s["spans"])


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of format_conversations(); the loss is read under the mask."""
    newline = F.lit("\n")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    plain = lambda x: F.when(F.col("formatted").startswith("<s:0>"), x).otherwise(_plain(x))
    loss = F.array_join(F.transform("loss", lambda s: plain(F.col("formatted").substr(s["first"] + 1, s["past"] - s["first"]))), "")
    return formatted.select("conv_id", "formatted", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), loss.alias("loss")).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars")
    )
