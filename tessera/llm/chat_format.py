"""Chat texts from event logs: events are folded into messages, messages are rendered, files are read back.

A log has (conv_id, message, seq, kind, role, text); ``message`` and ``seq`` may be of any type that orders.
It is split and sorted by conversation, message and sequence, so that a task folds its events as they pass and
holds one message and one part of a conversation.  A conversation with very many messages lies in several tasks
and parts, in order.

Kinds: ``open`` begins a message with a role and a text; ``delta`` appends; ``edit`` replaces the text; ``regenerate``
begins the text anew, and the role if it has one; ``drop`` takes the message out until it is opened or regenerated.  A
delta or an edit to a message that isn't there opens it.  Null roles and texts are empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm._common import named

ESCAPE = "\\"
LOG = ["conv_id", "message", "seq", "kind", "role", "text"]
PARTS = "conv_id long, part long, whole boolean, formatted string, loss array<struct<begin:int,end:int>>"


@dataclass(frozen=True)
class Template:
    """begin role newline text end, with control strings broken up inside roles and texts by a backslash.

    ``controls``: further strings that must not stand in a text as they are.  Roles in ``learned`` get the loss.
    """

    begin: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    controls: tuple[str, ...] = ("<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        for c in self.marks():
            if len(c) < 2 or ESCAPE in c or any(c[:k] == c[-k:] for k in range(1, len(c))):
                raise ValueError(f"{c!r} can't be a control string: two characters at least, no backslash, no end like its beginning")

    def marks(self) -> tuple[str, ...]:
        return (self.begin, self.end.rstrip("\n"), *self.controls)

    def escaped(self, text: str) -> str:
        text = text.replace(ESCAPE, ESCAPE * 2)
        for c in self.marks():
            text = text.replace(c, c[0] + ESCAPE + c[1:])
        return text

    def unescaped(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL) if ESCAPE in text else text

    def rendered(self, role: str, text: str) -> tuple[str, int, int]:
        """The turn, and where its text begins and ends in it."""
        head = self.begin + self.escaped(role).replace("\n", ESCAPE + "\n") + "\n"
        body = self.escaped(text)
        return head + body + self.end, len(head), len(head) + len(body)

    def parsed(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn; an error if anything else stands there."""
        turn, at, out = re.compile(re.escape(self.begin) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(self.end), re.DOTALL), 0, []
        while at < len(formatted):
            found = turn.match(formatted, at)
            if not found:
                raise ValueError(f"no turn begins at character {at}")
            out.append((self.unescaped(found[1]), self.unescaped(found[2])))
            at = found.end()
        return out


class Message:
    """One message, folded event by event."""

    def __init__(self) -> None:
        self.there, self.role, self.texts = False, "", [""]

    def fold(self, kind: str, role: str | None, text: str | None) -> None:
        if kind == "drop":
            self.there, self.texts = False, []
            return
        if kind not in ("open", "delta", "edit", "regenerate"):
            raise ValueError(f"unknown kind of event: {kind}")
        if kind == "open" or not self.there or (kind == "regenerate" and role is not None):
            self.role = role or ""
        if kind != "delta" or not self.there:
            self.texts = []
        self.texts.append(text or "")
        self.there = True


class Writer:
    """Parts of conversations, filled message by message."""

    def __init__(self, template: Template, place: int, most: int):
        self.template, self.part, self.most = template, place << 33, most
        self.first, self.conv, self.cut, self.out = True, None, False, []
        self.begin(None)

    def begin(self, conv: int | None) -> None:
        self.conv, self.texts, self.loss, self.size = conv, [], [], 0

    def add(self, conv: int | None, role: str, text: str) -> None:
        if not self.texts:
            self.begin(conv)
        elif conv != self.conv or self.size >= self.most:
            same = conv == self.conv
            self.close(whole=not self.first and not same and not self.cut)
            self.first, self.cut = self.first and same, same
            self.begin(conv)
        turn, begin, end = self.template.rendered(role, text)
        if role in self.template.learned:
            self.loss.append((self.size + begin, self.size + end))
        self.texts.append(turn)
        self.size += len(turn)

    def close(self, whole: bool) -> None:
        if self.texts:
            self.out.append((self.conv, self.part, whole, "".join(self.texts), self.loss))
            self.part += 1

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
            columns = list(zip(*self.out, strict=True))
            loss = pa.array([[{"begin": a, "end": b} for a, b in spans] for spans in columns[4]], kind)
            self.out = []
            yield pa.record_batch([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.string()), loss], names=["conv_id", "part", "whole", "formatted", "loss"])


def write_chats(log: DataFrame, path: str, template: Template = Template(), part_chars: int = 4 << 20) -> None:
    """The log's conversations as Parquet rows: conv_id, part, whole, formatted, loss (where the learned texts lie).

    ``whole`` says that the row is known to be all of its conversation; others have several rows, in the order of
    ``part``.  Messages that are dropped, and conversations without messages, leave nothing.  Null ids are one
    conversation.  Of events alike in message and seq any order may be taken.  An empty log writes an empty table.
    One message's events pass through one task, since its text is one value; any number of messages may share one
    conversation.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, own, message = Writer(template, TaskContext.get().partitionId(), part_chars), None, Message()
        for batch in batches:
            for conv, key, kind, role, text in zip(*[batch[c].to_pylist() for c in ("conv_id", "message", "kind", "role", "text")], strict=True):
                if (conv, key) != own:
                    if message.there:
                        writer.add(own[0], message.role, "".join(message.texts))
                        if writer.size >= part_chars:
                            yield from writer.taken()
                    own, message = (conv, key), Message()
                message.fold(kind, role, text)
            yield from writer.taken()
        if message.there:
            writer.add(own[0], message.role, "".join(message.texts))
        writer.close(whole=False)
        yield from writer.taken()

    spark = log.sparkSession
    rows = log.select(named("conv_id").cast("long").alias("conv_id"), *[named(c).alias(c) for c in LOG[1:]])
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "conv_id", "message").sortWithinPartitions("conv_id", "message", "seq")
    told = dealt.select("conv_id", F.to_json(F.struct("message")).alias("message"), "kind", "role", "text")
    told.mapInArrow(render, PARTS).write.option("compression", "zstd").parquet(path)


def read_chats(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(path)


class Digest:
    """What is told of one conversation, part by part."""

    def __init__(self, conv: int | None, template: Template):
        self.conv, self.template, self.turns, self.chars, self.learned = conv, template, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict]) -> None:
        for role, text in self.template.parsed(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = self.template.unescaped(formatted[span["begin"] : span["end"]])
            self.learned += len(text)
            self.loss.update(text.encode())
        self.chars += len(formatted)

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def chat_digests(spark: SparkSession, path: str, template: Template = Template()) -> DataFrame:
    """Per conversation, from the files: turns, digests of turns and of the text under the loss, and lengths.

    Rows that are whole conversations are read where they lie; the rest meets by conversation and passes in order,
    one part at a time (a digest can't be split).
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [c.split()[0] for c in DIGESTS.split(", ")], [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        table = lambda rows: pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        now = None
        for batch in batches:
            done = []
            for conv, whole, formatted, loss in zip(*[batch[c].to_pylist() for c in ("conv_id", "whole", "formatted", "loss")], strict=True):
                if now is None or whole or conv != now.conv:
                    done += [now.row()] if now else []
                    now = Digest(conv, template)
                now.add(formatted, loss)
            if done:
                yield table(done)
        if now:
            yield table([now.row()])

    parts = read_chats(spark, path)
    loose = parts.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return parts.where("whole").mapInArrow(digest, DIGESTS).unionByName(loose.mapInArrow(digest, DIGESTS))


def turn_events(turns: DataFrame, piece_chars: int = 256, most_pieces: int = 16) -> DataFrame:
    """The log that a chat service would have written for (conv_id, turn, role, text) rows.

    Assistants' answers are streamed: a draft, then a regeneration in pieces.  Other turns are opened empty, edited and
    continued.  Turns order by number, then role, then a hash of the text; null numbers come first; rows that repeat
    are messages of their own.
    """
    text = F.coalesce(named("text"), F.lit(""))
    size = F.greatest(F.lit(piece_chars), F.ceil(F.length("text") / most_pieces)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.ceil(F.length("text") / size).cast("int")), lambda i: F.substring(F.col("text"), i * size + 1, size))
    message = F.struct(named("turn").alias("turn"), named("role").alias("role"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = turns.select(named("conv_id").alias("conv_id"), message.alias("message"), F.coalesce(named("role"), F.lit("")).alias("role"), text.alias("text"))
    event = lambda kind, text, role=None: F.struct(F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"), text.alias("text"))
    deltas = F.transform(F.slice(pieces, 2, most_pieces + 1), lambda p: event("delta", p))
    streamed = F.concat(F.array(event("open", F.lit(""), F.col("role")), event("delta", F.substring("text", 1, 8)), event("regenerate", pieces[0])), deltas)
    typed = F.concat(F.array(event("open", F.lit(""), F.col("role")), event("edit", pieces[0])), deltas)
    events = F.when(F.col("role") == "assistant", streamed).otherwise(typed)
    return rows.select("conv_id", "message", F.posexplode(events).alias("seq", "e")).select("conv_id", "message", "seq", "e.kind", "e.role", "e.text")
