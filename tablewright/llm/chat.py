"""Chat formatting from event logs.

A log holds one row per event: ``conv``, ``seq`` (order in the conversation), ``message`` (which
message it is about), ``kind``, ``role`` and ``body``. Kinds: ``open`` begins a message and names
its role, ``delta`` appends a streamed part, ``edit`` replaces what the message holds, ``retry``
empties it for a new generation, ``drop`` deletes it. Folding gives the final messages; the
template renders them to one training text per conversation with the spans of its loss mask.

Everything here is DataFrame functions. Folding groups by message, so a long conversation is
split; only the finished text of one conversation is ever one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.store import written

HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
# Control strings and what stands for them inside texts. A backslash begins every code and is
# itself coded, so no code appears by accident.
CODES = [("\\", "\\b"), ("### ", "\\h"), ("</turn>", "\\t")]
ROLE_CODES = [*CODES, (":", "\\c")]


def escape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv, seq, role, text`` of a log; ``seq`` is that of a message's first event.

    Events that are equal in all columns count once, events of one ``seq`` apply in the order of
    their kind's name. Null bodies and roles are empty, null ``conv`` is a conversation of its own,
    and deltas without an ``open`` give a message without a role.
    """
    entry = F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("body", F.lit("")).alias("body"))
    logs = events.groupBy("conv", "message").agg(F.sort_array(F.collect_set(entry)).alias("log"))
    resets = F.transform(F.filter("log", lambda e: e.kind.isin("edit", "retry")), lambda e: e.seq)
    logs = logs.where(~F.exists("log", lambda e: e.kind == "drop")).withColumn("reset", F.array_max(resets))
    live = F.filter("log", lambda e: e.kind.isin("delta", "edit") & (F.col("reset").isNull() | (e.seq >= F.col("reset"))))
    opened = F.transform(F.filter("log", lambda e: e.kind == "open"), lambda e: e.role)
    return logs.select(
        "conv",
        F.col("log")[0].seq.alias("seq"),
        F.coalesce(F.try_element_at(opened, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e.body), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv, formatted, loss_spans`` (start, length in code points).

    The mask covers the escaped texts of ``loss_role`` and nothing else.
    """
    head = F.concat(F.lit(HEAD), escape(F.col("role"), ROLE_CODES), F.lit(AFTER_ROLE))
    parts = messages.select("conv", "seq", (F.col("role") == loss_role).alias("loss"), head.alias("head"), escape(F.col("text")).alias("body"))
    parts = parts.withColumn("segment", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv").orderBy("seq", "segment").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.select(
        "conv",
        "loss",
        "segment",
        F.coalesce(F.sum(F.length("segment").cast("long")).over(before), F.lit(0)).alias("start"),
        F.length("head").cast("long").alias("skip"),
        F.length("body").cast("long").alias("long"),
    )
    turn = F.struct("start", "segment", "loss", (F.col("start") + F.col("skip")).alias("at"), "long")
    turns = placed.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return turns.select(
        "conv",
        F.array_join(F.transform("turns", lambda t: t.segment), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.loss), lambda t: F.struct(t["at"].alias("start"), t["long"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Messages from rendered texts: ``conv, number, role, text, loss_text`` (null outside the mask).

    Linear in the text: turns and spans are rows that meet by their place.
    """
    pieces = formatted.select("conv", F.posexplode(F.split("formatted", END, -1)).alias("number", "piece"), F.size(F.split("formatted", END, -1)).alias("n"))
    pieces = pieces.where("number < n - 1")
    before = Window.partitionBy("conv").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    colon = F.instr("piece", AFTER_ROLE)
    read = pieces.select(
        "conv",
        "number",
        (F.coalesce(F.sum(F.length("piece").cast("long") + len(END)).over(before), F.lit(0)) + colon + len(AFTER_ROLE) - 1).alias("at"),
        unescape(F.substring("piece", F.lit(len(HEAD) + 1), colon - 1 - len(HEAD)), ROLE_CODES).alias("role"),
        F.substring("piece", colon + len(AFTER_ROLE), F.length("piece")).alias("body"),
    )
    spans = formatted.select(F.col("conv").alias("of"), F.inline("loss_spans")).withColumnRenamed("length", "covers")
    met = read.join(spans, F.col("conv").eqNullSafe(F.col("of")) & (F.col("at") == F.col("start")), "left")
    loss = F.when(F.col("covers").isNotNull(), unescape(F.substring("body", F.lit(1), F.col("covers").cast("int"))))
    return met.select("conv", "number", "role", unescape(F.col("body")).alias("text"), loss.alias("loss_text"))


def conversation_events(rows: DataFrame) -> DataFrame:
    """The event log that streaming ``rows`` (conv_id, turn, role, text) would leave.

    Texts arrive in two deltas; an assistant's is generated again after a draft, a user's is
    edited. Rows are numbered by turn, ties by role and text, so repeated rows stay messages of
    their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    text, half = F.coalesce("text", F.lit("")), F.floor(F.length(F.coalesce("text", F.lit(""))) / 2).cast("int")
    n = F.col("message")

    def event(step: int, kind: str, body: Column | None = None) -> Column:
        role = F.col("role") if kind == "open" else F.lit(None).cast("string")
        shown = F.lit(None).cast("string") if body is None else body
        return F.struct((8 * n + step).alias("seq"), F.lit(kind).alias("kind"), role.alias("role"), shown.alias("body"))

    first, second = F.substring(text, F.lit(1), half), F.substring(text, half + 1, F.length(text))
    streamed = [event(4, "delta", first), event(5, "delta", second)]
    again = F.array(event(0, "open"), event(1, "delta", second), event(3, "retry"), *streamed)
    edited = F.array(event(0, "open"), event(1, "delta", first), event(3, "edit", text))
    plain = F.array(event(0, "open"), *streamed)
    events = F.when(F.col("role") == "assistant", again).when(F.col("role") == "user", edited).otherwise(plain)
    numbered = rows.select(F.col("conv_id").alias("conv"), "role", "text", F.row_number().over(order).cast("long").alias("message"))
    return numbered.select("conv", "message", F.inline(events))


def format_log(events: DataFrame) -> DataFrame:
    """Fold and render a log; the result is a stored table."""
    return written(render(fold(events)), "chat")
