"""Chat formatting by event-sourced reconstruction.

Input is a log of events (conv_id, seq, event, message_id, role, text):

* ``message`` starts or restarts a message with its text, ``delta`` appends to it, ``edit`` replaces its text;
* ``regenerate`` replaces its text and cuts every message of the conversation that began after this one began and before the event.

The fold runs by message first (a long conversation is spread over tasks, streamed deltas are gathered where they belong), then
conversations are put together in order of the messages' first seq, and rendered. The template is

    <s>[INST]role[/INST]text</s>

for each turn; a control string inside a role or text gets a backslash after its first character, and one that already has
backslashes there gets one more, so that unescaping gives back every text exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import slices

BEGIN, ROLE, ROLE_END, END = "<s>", "[INST]", "[/INST]", "</s>"
#: A control string with any number of backslashes after its first character.
_PLAIN = r"([<\[])(\\*)(/?(?:s>|INST\]))"
_ESCAPED = r"([<\[])\\(\\*)(/?(?:s>|INST\]))"
_UNESCAPE = re.compile(_ESCAPED)


def escape(text: Column) -> Column:
    """Control strings made harmless."""
    return F.regexp_replace(text, _PLAIN, r"$1\\$2$3")


def unescape(text: str) -> str:
    """The text before escape()."""
    return _UNESCAPE.sub(r"\1\2\3", text)


def turns_to_events(turns: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as a log: each row is one ``message`` event; repeated rows stay apart."""
    return turns.select(
        "conv_id", F.col("turn").cast("long").alias("seq"), F.lit("message").alias("event"),
        F.monotonically_increasing_id().alias("message_id"), "role", "text",
    )


def turns_to_log(turns: DataFrame, salt: int = 0) -> DataFrame:
    """The same turns as they may have come about: a log with streamed deltas, edits and regenerations whose fold gives these turns back.

    By a hash of conversation, turn and salt a turn is one ``message``; an empty ``message`` and three ``delta`` parts of the text; a draft and an ``edit``; or a
    draft, an answer to it and a ``regenerate`` that gives the text and cuts that answer. Turn t has the places 8 t to 8 t + 3, so turns stay below 2^59 in size; a turn
    without a number is one ``message``. Repeated rows are messages of their own.
    """
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    draft = F.substr(text, F.lit(1), third)

    def event(step: int, kind: str, said: Column, role: Column | None = None, answer: bool = False) -> Column:
        own = F.col("id") * 2 + int(answer)
        role = F.lit(None).cast("string") if role is None else role
        return F.struct((F.col("turn").cast("long") * 8 + step).alias("seq"), F.lit(kind).alias("event"), own.alias("message_id"), role.alias("role"), said.alias("text"))

    role = F.col("role")
    parts = [F.substr(text, k * third + 1, third) for k in range(3)]
    whole = F.array(event(0, "message", text, role))
    streamed = F.array(event(0, "message", F.lit(""), role), *[event(k + 1, "delta", part) for k, part in enumerate(parts)])
    edited = F.array(event(0, "message", draft, role), event(1, "edit", text))
    again = F.array(event(0, "message", draft, role), event(1, "message", draft, F.lit("assistant"), answer=True), event(2, "regenerate", text))
    way = F.pmod(F.xxhash64("conv_id", "turn", F.lit(salt)), F.lit(4))
    steps = F.when(F.col("turn").isNull() | (way == 0), whole).when(way == 1, streamed).when(way == 2, edited).otherwise(again)
    told = turns.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("id"))
    return told.select("conv_id", F.explode(steps).alias("e")).select("conv_id", "e.*")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, begin, role, text) of the messages that stand at the end of the log.

    Nulls: seq sorts first, text counts as empty, an event of unknown kind is ignored, role is that of the message's first event that has one;
    a null conv_id or message_id is a key like any other. Events of equal seq go in order of kind, then text; of messages with equal
    seq the order is role, then text.
    """
    none = -(2**62)
    rank = F.expr("CASE event WHEN 'message' THEN 0 WHEN 'regenerate' THEN 1 WHEN 'edit' THEN 2 ELSE 3 END").alias("rank")
    log = events.where(F.col("event").isin("message", "delta", "edit", "regenerate")).select(
        "conv_id", "message_id", F.coalesce(F.col("seq").cast("long"), F.lit(none)).alias("seq"), rank, "event", "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    folded = log.groupBy("conv_id", "message_id").agg(
        F.sort_array(F.collect_list(F.struct("seq", "rank", "text"))).alias("steps"),
        F.min("seq").alias("begin"),
        F.max(F.when(F.col("rank") < 3, F.struct("seq", "rank"))).alias("reset"),
        F.max(F.when(F.col("event") == "regenerate", F.col("seq"))).alias("again"),
        F.min_by("role", F.struct("seq", "rank", "role")).alias("role"),
    )
    kept = F.filter("steps", lambda s: F.col("reset").isNull() | (F.struct(s["seq"], s["rank"]) >= F.col("reset")))
    # of several resets at the very same place the last in order of text counts
    heads = F.filter(kept, lambda s: s["rank"] < 3)
    tail = F.filter(kept, lambda s: s["rank"] == 3)
    parts = F.when(F.size(heads) > 0, F.concat(F.array(F.element_at(heads, -1)["text"]), F.transform(tail, lambda s: s["text"]))).otherwise(F.transform(tail, lambda s: s["text"]))
    messages = folded.select("conv_id", "begin", "again", F.coalesce("role", F.lit("")).alias("role"), F.array_join(parts, "").alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("begin").rangeBetween(Window.unboundedPreceding, -1)
    cut = F.max("again").over(earlier)
    return messages.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("cut") <= F.col("begin"))).select("conv_id", "begin", "role", "text")


def render(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, n_turns, loss_spans): one row a conversation.

    loss_spans lists start and end of the escaped text of each turn whose role is under the loss, in code points of formatted.
    """
    head = F.concat(F.lit(BEGIN + ROLE), escape(F.col("role")), F.lit(ROLE_END))
    body = escape(F.col("text"))
    pieces = messages.select("conv_id", "begin", "role", "text", head.alias("head"), body.alias("body"))
    pieces = pieces.withColumn("width", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy("begin", "role", "text")
    start = F.coalesce(F.sum("width").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("head")
    rows = pieces.select("conv_id", F.row_number().over(order).alias("n"), "role", F.concat("head", "body", F.lit(END)).alias("piece"), start.alias("start"), F.length("body").alias("size"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "piece", "role", "start", "size"))).alias("turns"))
    under = F.filter("turns", lambda t: t["role"].isin(*loss_roles))
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.size("turns").cast("long").alias("n_turns"),
        F.transform(under, lambda t: F.struct(t["start"].alias("start"), (t["start"] + t["size"]).alias("end"))).alias("loss_spans"),
    )


def render_turns(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, n, piece, start, end) of each turn: render() without putting a conversation into one row.

    start and end are the loss span in code points of the whole, null for other roles. The rows of a conversation lie in one partition in
    order; only a sort gathers them there and the running offset is all that a task holds, so a conversation may be of any length.
    """
    head = F.concat(F.lit(BEGIN + ROLE), escape(F.col("role")), F.lit(ROLE_END))
    body = escape(F.col("text"))
    sorted_ = messages.repartition("conv_id").sortWithinPartitions("conv_id", "begin", "role", "text")
    pieces = sorted_.select("conv_id", F.concat(head, body, F.lit(END)).alias("piece"), F.length(head).alias("head"), F.length(body).alias("size"), F.col("role").isin(*loss_roles).alias("under"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n, at = object(), 0, 0
        for batch in slices(batches):
            rows = []
            for own, head, size, under in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "size", "under")), strict=True):
                if own != conv:
                    conv, n, at = own, 0, 0
                n += 1
                rows.append((n, at + head if under else None, at + head + size if under else None))
                at += head + size + len(END)
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), columns[0], batch.column("piece"), *columns[1:]], names=["conv_id", "n", "piece", "start", "end"])

    return pieces.mapInArrow(number, f"conv_id {dict(messages.dtypes)['conv_id']}, n long, piece string, start long, end long")


def format_chats(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Fold a log and render it."""
    return render(fold(events), loss_roles)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a rendered conversation."""
    turns = []
    for piece in formatted.split(END)[:-1]:
        role, _, text = piece[len(BEGIN + ROLE):].partition(ROLE_END)
        turns.append((unescape(role), unescape(text)))
    return turns


def read_back(formatted: str, spans: str) -> Column:
    """What the rendered text holds, read from it alone and from the loss spans: a struct of counts and digests."""
    return F.pandas_udf(_read_back, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")(formatted, spans)


def read_turns(turns: DataFrame) -> DataFrame:
    """conv_id and what read_back gives, of turns as render_turns leaves them: pieces are read one by one into running counts and digests."""
    kind = dict(turns.dtypes)["conv_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        began, conv, n, chars, loss_chars, whole, loss = False, None, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for batch in slices(batches):
            done = []
            for own, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "start", "end")), strict=True):
                if began and own != conv:
                    done.append((conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars))
                if not began or own != conv:
                    began, conv, n, chars, loss_chars, whole, loss = True, own, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, said in parse(piece):
                    n += 1
                    whole.update(f"{role}\n{said}\n".encode())
                if start is not None:
                    said = unescape(piece[start - chars:end - chars])
                    loss_chars += len(said)
                    loss.update(said.encode())
                chars += len(piece)
            if done:
                yield rows(done, batch.schema.field("conv_id").type)
        if began:
            yield rows([(conv, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars)], batch.schema.field("conv_id").type)

    def rows(done: list[tuple], key: pa.DataType) -> pa.RecordBatch:
        kinds = [key, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["conv_id", *_READ])

    return turns.select("conv_id", "piece", "start", "end").mapInArrow(read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_READ = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def _read_back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    rows = []
    for text, marked in zip(formatted, spans, strict=True):
        turns = parse(text)
        loss = "".join(unescape(text[s["start"]:s["end"]]) for s in marked)
        whole = "".join(f"{role}\n{said}\n" for role, said in turns)
        rows.append((len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
    return pd.DataFrame(rows, columns=_READ)
