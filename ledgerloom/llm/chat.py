"""Chat formatting from event logs, with DataFrame functions only.

A log holds one row per event: conv_id, seq, kind, message_id, role, text.
  message     opens a message with a first text (a repeated one replaces the text so far)
  delta       appends text to its message
  edit        replaces the text of its message so far
  regenerate  empties its message and withdraws all messages opened after it, up to this event
The folded messages of a conversation are rendered in the order in which they were opened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START, END, LITERAL, BREAK = "<|im_start|>", "<|im_end|>", "<|lit|>", "<|nl|>"


def escape(text):
    """Every `<|` of a text becomes `<|lit|>`, so no other control string is left in it."""
    return F.replace(text, F.lit("<|"), F.lit(LITERAL))


def unescape(text):
    return F.replace(text, F.lit(LITERAL), F.lit("<|"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, position, message_id, role, text: the final messages.

    One shuffle, by conversation; the log of a conversation streams through windows and isn't
    held as a whole, only its messages' own texts are. Events of equal seq stand by kind
    (message, edit, regenerate, delta), then role, then text. A null text counts as empty, a
    null kind as message; a null role is empty. Events that name no opened message open one.
    """
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("message", 0, "edit", 1, "regenerate", 2, "delta", 3)]), F.col("kind"))
    log = events.select(
        "conv_id", "seq", F.coalesce("kind", F.lit("message")).alias("kind"), "message_id",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    conv = Window.partitionBy("conv_id").orderBy("seq", rank, "role", "text")
    log = log.withColumn("at", F.row_number().over(conv))
    message = Window.partitionBy("conv_id", "message_id")
    resets = F.col("kind").isin("message", "edit", "regenerate")
    log = log.withColumns({
        "opened": F.min("at").over(message),
        "reset": F.max(F.when(resets, F.col("at"))).over(message),
    })
    # Backwards, so that a frame grows with each event and is never computed again.
    later = Window.partitionBy("conv_id").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    log = log.withColumn("withdrawn", F.min(F.when(F.col("kind") == "regenerate", F.col("opened"))).over(later))
    live = log.groupBy("conv_id", "message_id").agg(
        F.min("opened").alias("opened"),
        F.min_by("role", "at").alias("role"),
        F.min_by("withdrawn", "at").alias("withdrawn"),
        F.array_sort(F.collect_list(F.when(
            (F.col("at") >= F.coalesce("reset", "opened")) & (F.col("kind") != "regenerate"), F.struct("at", "text")))).alias("parts"))
    return live.where("withdrawn IS NULL OR withdrawn >= opened").select(
        "conv_id", F.col("opened").alias("position"), "message_id", "role",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, train_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, segments and loss_spans of each conversation.

    formatted marks each turn as `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a
    line feed; `<|` inside roles and texts is escaped reversibly, as is a line feed in a role.
    segments (text, train) concatenate to formatted; train holds for the texts of train_role.
    loss_spans are the begin and length, in code points, of the segments with train. A turn's
    place is the sum of the lengths before it, so the work is linear in the turns.
    """
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK))
    rows = messages.select("conv_id", "position", F.concat(F.lit(START), role, F.lit("\n")).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == train_role).alias("train"))
    before = Window.partitionBy("conv_id").orderBy("position", "head", "body").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + len(END) + 1
    rows = rows.withColumn("begin", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", "head", "body", "train", "begin"))).alias("turns"))
    part = lambda text, train: F.struct(text.alias("text"), train.alias("train"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(part(t["head"], F.lit(False)), part(t["body"], t["train"]), part(F.lit(END + "\n"), F.lit(False)))))
    spans = F.transform(F.filter("turns", lambda t: t["train"]), lambda t: F.struct(t["begin"].alias("begin"), F.length(t["body"]).cast("long").alias("length")))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return turns.select("conv_id", formatted.alias("formatted"), segments.alias("segments"), spans.alias("loss_spans"))


def parse(formatted: DataFrame) -> DataFrame:
    """turns (role, text) of each conversation, read back from the formatted string."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    def back(piece):
        body = F.substr(piece, F.lit(len(START) + 1))
        cut = F.instr(body, F.lit("\n"))
        return F.struct(
            unescape(F.replace(F.substr(body, F.lit(1), cut - 1), F.lit(BREAK), F.lit("\n"))).alias("role"),
            unescape(F.substr(body, cut + 1)).alias("text"))
    return formatted.withColumn("turns", F.transform(pieces, back))


def format_chats(events: DataFrame) -> DataFrame:
    """Event log to formatted conversations: fold, then render.

    A null conv_id is a conversation of its own. An empty log gives an empty result. Columns
    other than the six of a log are not read. Repeated events are folded as often as they come.
    """
    return render(fold(events))


def turns_as_events(turns: DataFrame) -> DataFrame:
    """A log of whole messages from rows of conv_id, turn, role, text. Rows of equal turn stand
    by role, then text; each row is a message of its own, a repeated row too."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = F.row_number().over(order)
    return turns.select("conv_id", seq.alias("seq"), F.lit("message").alias("kind"), seq.alias("message_id"), "role", "text")


def streamed(turns: DataFrame) -> DataFrame:
    """A log as a chat service writes it, whose folded messages are the rows of turns. Every
    text comes in two deltas. Every third message begins with a draft that an edit replaces; an
    assistant's message is first answered otherwise and asked about, and regenerated, which
    withdraws the question."""
    rows = turns_as_events(turns).select("conv_id", "seq", F.col("message_id").cast("string").alias("id"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    half = F.floor(F.length("text") / 2).cast("int")
    first, second = F.substr(F.col("text"), F.lit(1), half), F.substr(F.col("text"), half + 1)
    event = lambda k, kind, text, id_=F.col("id"), role=F.col("role"): F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), id_.alias("message_id"), role.alias("role"), text.alias("text"))
    empty, draft = F.lit(""), F.lit("a draft <|im_end|>\n")
    aside = F.concat(F.col("id"), F.lit("?"))
    regenerated = [event(0, "message", draft), event(1, "delta", draft), event(2, "message", F.lit("why?"), aside, F.lit("user")), event(3, "regenerate", empty), event(4, "delta", first), event(5, "delta", second)]
    edited = [event(0, "message", draft), event(1, "delta", draft), event(2, "edit", first), event(3, "delta", second)]
    plain = [event(0, "message", empty), event(1, "delta", first), event(2, "delta", second)]
    events = F.when(F.col("role") == "assistant", F.array(*regenerated)).when(F.col("seq") % 3 == 0, F.array(*edited)).otherwise(F.array(*plain))
    log = rows.select("conv_id", "seq", F.explode(events).alias("e"))
    return log.select("conv_id", (F.col("seq").cast("long") * 8 + F.col("e.k")).alias("seq"), "e.kind", "e.message_id", "e.role", "e.text")


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted strings and their loss spans."""
    back = parse(formatted)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    masked = F.transform("loss_spans", lambda s: F.substr(F.col("formatted"), (s["begin"] + 1).cast("int"), s["length"].cast("int")))
    loss = F.array_join(F.transform(masked, unescape), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))
