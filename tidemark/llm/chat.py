"""Chat formatting with a grammar that reads back exactly.

A turn is `<s>role[INST]text</s>`, a conversation its turns in order. A backslash before a character makes it ordinary,
and the parser (split at `</s>`, take off `<s>`, cut at the first `[INST]`, drop the escaping backslashes) needs no
look-ahead. Rendered turns are parsed again and compared with their source; one that doesn't come back, or
that holds a control string, is escaped: first where a control string or backslash stands, then, should that not do, at
every character that any control string has. All of it is JVM expressions.

Null text, role: empty. Null conversation ids form one conversation. A conversation, that one too, is one row of the result, so its
turns meet in one task. Turns with equal numbers are ordered by role and text,
null numbers come first. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sha256

CONTROL = ["<s>", "</s>", "[INST]", "[/INST]"]
OPEN, CLOSE, MARK = "<s>", "</s>", "[INST]"


def escape(text: Column, level: int) -> Column:
    """0: as it is; 1: a backslash after the first character of control strings and before backslashes; 2: before each character of theirs."""
    if level == 0:
        return text
    if level == 1:
        return F.regexp_replace(text, r"\\|<(?=/?s>)|\[(?=/?INST\])", r"$0\\")
    return F.regexp_replace(text, r"[\\<>\[\]/]", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role, F.lit(MARK), text, F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """Array of (role, text, shown_role, shown): the turns of a formatted conversation, unescaped, and both as they stand there."""
    # no control string is left whole inside a turn, so these splits see only the grammar's own
    parts = F.split(formatted, r"</s>", -1)
    turns = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    body = lambda t: F.split(F.substr(t, F.lit(len(OPEN) + 1)), r"\[INST\]", 2)
    return F.transform(turns, lambda t: F.struct(unescape(body(t)[0]).alias("role"), unescape(F.coalesce(F.get(body(t), F.lit(1)), F.lit(""))).alias("text"), body(t)[0].alias("shown_role"), F.coalesce(F.get(body(t), F.lit(1)), F.lit("")).alias("shown")))


def _returns(rendered: Column, role: Column, text: Column) -> Column:
    back = parse(rendered)
    return (F.size(back) == 1) & (F.get(back, F.lit(0))["role"] == role) & (F.get(back, F.lit(0))["text"] == text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, rendered, level: every turn rendered at the lowest level at which it reads back."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    # only turns with a control character can differ; the others need no parse
    plain = ~F.concat("role", F.lit(" "), "text").rlike(r"[\\<>\[\]]")
    for level in (0, 1):
        rows = rows.withColumn(f"r{level}", render(escape(F.col("role"), level), escape(F.col("text"), level)))
    control = F.concat("role", F.lit("\n"), "text").rlike(r"</?s>|\[/?INST\]")
    level = F.when(plain, 0).when(~control & _returns(F.col("r0"), F.col("role"), F.col("text")), 0).when(_returns(F.col("r1"), F.col("role"), F.col("text")), 1).otherwise(2)
    rows = rows.withColumn("level", level)
    full = render(escape(F.col("role"), 2), escape(F.col("text"), 2))
    return rows.select("conv_id", "turn", "role", "text", F.when(F.col("level") == 0, F.col("r0")).when(F.col("level") == 1, F.col("r1")).otherwise(full).alias("rendered"), "level")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (as read back: role, text, shown), identical: whether they equal the source's turns."""
    turns = format_turns(conversations)
    group = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "rendered"))).alias("own"))
    shown = group.select("conv_id", "own", F.array_join(F.transform("own", lambda t: t["rendered"]), "").alias("formatted"))
    back = shown.select("conv_id", "own", "formatted", parse(F.col("formatted")).alias("turns"))
    same = F.transform("own", lambda t: F.struct(t["role"], t["text"])) == F.transform("turns", lambda t: F.struct(t["role"], t["text"]))
    return back.select("conv_id", "formatted", "turns", same.alias("identical"))


def loss_spans(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, spans: array of (start, end) in code points of formatted, end exclusive, that the loss covers."""
    begin = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(_whole(t))).alias("at"),
            F.when(t["role"] == role, F.concat(acc["spans"], F.array(F.struct((acc["at"] + F.length(_whole(t)) - len(CLOSE) - F.length(t["shown"])).cast("long").alias("start"), (acc["at"] + F.length(_whole(t)) - len(CLOSE)).cast("long").alias("end"))))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return formatted.select("conv_id", begin.alias("spans"))


def _whole(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["shown_role"], F.lit(MARK), t["shown"], F.lit(CLOSE))


def digests(formatted: DataFrame, role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, identical; all from what was read back."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"]), "")
    held = formatted.select("conv_id", F.size("turns").cast("long").alias("n_turns"), sha256(turns).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "identical")
    return held.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), sha256(F.col("loss")).alias("loss_sha256"), "formatted_chars", "identical")
