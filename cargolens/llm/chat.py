"""Chat formatting from an event log.

A conversation is a log of events in the order of ``seq``: messages are opened, deltas of streamed
text are appended, an edit replaces a message's text, a regeneration empties it; both drop the
messages that were opened between the message and the event, as they answered to what is gone. The
fold first joins the events of each message, which spreads long conversations over many tasks, then
the messages of each conversation, and renders them with a template whose control strings cannot
come from a text. Only the finished conversation, one value of the result, is put together in a
single place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, END, TEXT, TEXT_END = "<s>", "</s>", "[INST]", "[/INST]"
CONTROLS = (TURN, END, TEXT, TEXT_END)
ESCAPE = "␛"


def escaped(text: Column) -> Column:
    """Text without control strings: an escape stands after the first character of each.

    Escapes in the text itself are doubled, so ``unescaped`` gives the text back.
    """
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(c[0] + ESCAPE + c[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, f"{ESCAPE}({ESCAPE}?)", "$1")


def messages(events: DataFrame) -> DataFrame:
    """conv_id, opened, message, role, text of the messages that a log leaves.

    Events (conv_id, seq, kind, message, role, text) have the kinds open, delta, edit, regenerate;
    others, those before their message is opened and those without seq count for nothing. Null
    texts and roles are empty. Of events with the same seq, deltas come
    last, and then the alphabetical order of kind and text decides. Null conv_ids are one conversation. A message opened again begins anew in its
    place and keeps the role of the first opening.
    """
    kind, seq = F.col("kind"), F.col("seq")
    text = F.coalesce("text", F.lit(""))
    known = events.filter("seq IS NOT NULL AND kind IN ('open', 'delta', 'edit', 'regenerate')")
    folded = known.groupBy("conv_id", "message").agg(
        F.min(F.when(kind == "open", F.struct(seq, F.coalesce("role", F.lit("")).alias("role")))).alias("o"),
        F.max(F.when(kind.isin("open", "edit", "regenerate"), seq)).alias("reset"),
        F.max(F.when(kind.isin("edit", "regenerate"), seq)).alias("cut"),
        F.array_sort(F.collect_list(F.struct(seq, F.when(kind != "delta", 0).otherwise(1).alias("late"), kind, text.alias("text")))).alias("parts"),
    )
    folded = folded.filter("o IS NOT NULL").select(
        "conv_id",
        "message",
        F.col("o.seq").alias("opened"),
        F.col("o.role").alias("role"),
        "cut",
        F.array_join(
            F.transform(F.filter("parts", lambda p: p["seq"] >= F.col("reset")), lambda p: p["text"]), ""
        ).alias("text"),
    )
    before = W.partitionBy("conv_id").orderBy("opened", "message").rowsBetween(W.unboundedPreceding, -1)
    dropped = F.coalesce(F.max("cut").over(before) > F.col("opened"), F.lit(False))
    return folded.withColumn("dropped", dropped).filter("NOT dropped").drop("dropped", "cut")


def formatted(turns: DataFrame, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted and loss_spans of turns (conv_id, opened, message, role, text).

    ``loss_spans`` are the code points (start, end exclusive) of texts whose role is ``learnt``.
    """
    role, text = escaped(F.col("role")), escaped(F.col("text"))
    head = F.concat(F.lit(TURN), role, F.lit(TEXT))
    order = W.partitionBy("conv_id").orderBy("opened", "message").rowsBetween(W.unboundedPreceding, -1)
    parts = turns.select(
        "conv_id",
        "opened",
        "message",
        F.concat(head, text, F.lit(TEXT_END + END)).alias("segment"),
        F.length(head).cast("long").alias("to_text"),
        F.length(text).cast("long").alias("size"),
        F.col("role").isin(*learnt).alias("learnt"),
    )
    start = F.coalesce(F.sum(F.length("segment")).over(order), F.lit(0)) + F.col("to_text")
    parts = parts.withColumn("start", start)
    span = F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"))
    return (
        parts.groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("opened", "message", "segment"))).alias("s"),
            F.array_sort(F.collect_list(F.when(F.col("learnt"), span))).alias("loss_spans"),
        )
        .select("conv_id", F.array_join("s.segment", "").alias("formatted"), "loss_spans")
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """``rendered`` with what its text says: turns (role, text) and learnt (texts under the mask)."""
    rows = F.split("formatted", END)
    rows = F.slice(rows, 1, F.greatest(F.size(rows) - 1, F.lit(0)))

    def turn(row: Column) -> Column:
        body = F.substring(row, len(TURN) + 1, F.length(row))
        role = F.substring_index(body, TEXT, 1)
        skip = F.length(role) + len(TEXT)
        text = F.substring(body, skip + 1, F.length(body) - skip - len(TEXT_END))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    # spans are cut out of a few rows put together, about the square root of all, so that a long conversation is not
    # gone through again for each of its spans (a walk that gathers texts copies all of them at each step)
    some = F.greatest(F.ceil(F.sqrt(F.size("_rows"))).cast("int"), F.lit(1))
    parts = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("_rows"), some), lambda i: i < F.size("_rows")),
        lambda i: F.concat(F.array_join(F.slice("_rows", i + 1, some), END), F.lit(END)),
    )
    begins = F.aggregate(
        "_parts", F.array(F.lit(0).cast("long")), lambda at, part: F.concat(at, F.array(F.element_at(at, -1) + F.length(part)))
    )

    def texts(part: Column, i: Column) -> Column:
        begin, end = F.get("_begins", i), F.get("_begins", i + 1)
        inside = F.filter("loss_spans", lambda s: (s["start"] >= begin) & (s["start"] < end))
        return F.transform(
            inside, lambda s: unescaped(F.substring(part, (s["start"] - begin).cast("int") + 1, (s["end"] - s["start"]).cast("int")))
        )

    cut = rendered.withColumn("_rows", rows).withColumn("_parts", parts).withColumn("_begins", begins)
    cut = cut.withColumn("turns", F.transform("_rows", turn)).withColumn("learnt", F.flatten(F.transform("_parts", texts)))
    return cut.drop("_rows", "_parts", "_begins")


def event_log(conversations: DataFrame) -> DataFrame:
    """A log that ends in ``conversations`` (conv_id, turn, role, text), one message a row.

    Assistant texts are streamed, regenerated and streamed again in parts; other texts are first
    wrong, get a stray answer, and are edited. Rows are taken in order of turn, role and text, nulls
    first; repeated rows are messages of their own.
    """
    number = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")).cast("long")
    rows = conversations.select(
        "conv_id",
        number.alias("n"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    half = F.floor(F.length("text") / 2).cast("int")
    first = F.substring(F.col("text"), F.lit(1), half)
    rest = F.substring(F.col("text"), half + 1, F.length("text"))
    mine, stray = F.col("n") * 2, F.col("n") * 2 + 1

    def event(k: int, kind: str, message: Column, role: Column, text: Column) -> Column:
        return F.struct(
            (F.col("n") * 8 + k).alias("seq"),
            F.lit(kind).alias("kind"),
            message.alias("message"),
            role.alias("role"),
            text.alias("text"),
        )

    none, empty = F.lit(None).cast("string"), F.lit("")
    streamed = F.array(
        event(0, "open", mine, F.col("role"), empty),
        event(1, "delta", mine, none, rest),
        event(2, "regenerate", mine, none, none),
        event(3, "delta", mine, none, first),
        event(4, "delta", mine, none, rest),
    )
    edited = F.array(
        event(0, "open", mine, F.col("role"), rest),
        event(1, "open", stray, F.lit("assistant"), F.lit("stray")),
        event(2, "delta", stray, none, first),
        event(3, "edit", mine, none, first),
        event(4, "delta", mine, none, rest),
    )
    events = F.when(F.col("role") == "assistant", streamed).otherwise(edited)
    return rows.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """The digest columns of conversations that went through the event log and the template."""
    read = read_back(formatted(messages(event_log(conversations))))
    spoken = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spoken, ""), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
