"""Chat formatting with typed content parts.

A visitor walks the parts of a turn in order: text is escaped, an image, audio or document part becomes a
placeholder, an attachment reference and a count of the tokens the placeholder expands to. A turn becomes one
marked segment; a conversation's format is its segments in turn order. Segments are made row by row, so a
conversation of any length never has to fit in one task. Reading back streams over the segments.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
PART = "struct<kind:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
SEGMENT = (
    "segment string, loss_start long, loss_end long, text_words long, expanded_tokens long, "
    "attachments array<struct<place:int,kind:string,uri:string,at:long,tokens:long>>"
)

_OPENER = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_WORD = re.compile(r"\w+|[^\w\s]")


def escape(text: str) -> str:
    """No control string can stand in the result: ``<|`` gets a backslash, ``<\\|`` one more."""
    return _OPENER.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _role(role: str | None) -> str:
    return escape((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def _unrole(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class Visitor:
    """Flattens the parts of one turn; ``visit_<kind>`` per kind of part."""

    def __init__(self, patch: int = 28, audio_rate: int = 25, page_tokens: int = 256):
        self.patch, self.audio_rate, self.page_tokens = patch, audio_rate, page_tokens
        self.pieces: list[tuple[str, dict | None]] = []  # a text, or an attachment in its place
        self.attachments: list[dict] = []
        self.words = 0

    def visit(self, part: dict) -> None:
        handler = getattr(self, f"visit_{part.get('kind') or 'text'}", None)
        if handler is None:
            raise ValueError(f"unknown kind of part: {part.get('kind')}")
        handler(part)

    def visit_text(self, part: dict) -> None:
        text = part.get("text") or ""
        self.words += len(_WORD.findall(text))
        self.pieces.append((text, None))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        place = len(self.attachments) + 1
        self.attachments.append({"place": place, "kind": kind, "uri": part.get("uri"), "at": 0, "tokens": tokens})
        self.pieces.append(("", self.attachments[-1]))

    def visit_image(self, part: dict) -> None:
        wide, high = (-(-max(part.get(c) or self.patch, 1) // self.patch) for c in ("width", "height"))
        self._attach("image", part, wide * high)

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, -(-int((part.get("seconds") or 0) * 1000) * self.audio_rate // 1000)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(part.get("pages") or 1, 1) * self.page_tokens)


def format_turn(role: str | None, parts: list[dict] | None, trained: bool) -> tuple:
    """(segment, loss_start, loss_end, text_words, expanded_tokens, attachments); the loss range is within the
    segment and empty for turns that are not trained on. ``at`` of an attachment is its offset in the segment."""
    visitor = Visitor()
    for part in parts or []:
        visitor.visit(part)
    head = f"{OPEN}{_role(role)}\n"
    body, run, at = [], [], len(head)
    for text, attachment in visitor.pieces:
        run.append(text)
        if attachment is not None:
            # texts are escaped as one string between placeholders, so nothing can form across two text parts
            body.append(escape("".join(run)))
            run.clear()
            attachment["at"] = at + len(body[-1])
            body.append(f"<|{attachment['kind']}_{attachment['place']}|>")
            at = attachment["at"] + len(body[-1])
    body.append(escape("".join(run)))
    at += len(body[-1])
    span = (len(head), at) if trained else (0, 0)
    expanded = visitor.words + sum(a["tokens"] for a in visitor.attachments)
    return f"{head}{''.join(body)}{CLOSE}\n", *span, visitor.words, expanded, visitor.attachments


def parse_segments(chunk: str) -> list[tuple[str, str]]:
    """(role, raw text, still escaped) of every turn in a piece of formatted output that ends with a turn."""
    out = []
    for turn in chunk.split(OPEN)[1:]:
        role, _, rest = turn.partition("\n")
        out.append((_unrole(role), rest[: rest.index(CLOSE)]))
    return out


def _segments(batches):
    for batch in batches:
        roles, parts, trained = (batch.column(c).to_pylist() for c in ("role", "parts", "trained"))
        made = [format_turn(*x) for x in zip(roles, parts, trained)]
        cols = list(zip(*made)) if made else [[] for _ in range(6)]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([
            ("place", pa.int32()), ("kind", pa.string()), ("uri", pa.string()), ("at", pa.int64()), ("tokens", pa.int64())]))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv_id"), batch.column("turn"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
            names=["conv_id", "turn", "segment", "loss_start", "loss_end", "text_words", "expanded_tokens", "attachments"])


def text_part(text: Column) -> Column:
    """A turn's only part, a text, as an array of parts."""
    void = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("kind"), text.cast("string").alias("text"), void.cast("string").alias("uri"),
        void.cast("int").alias("width"), void.cast("int").alias("height"), void.cast("double").alias("seconds"),
        void.cast("int").alias("pages")))


def format_turns(turns: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One segment per row of ``turns`` (conv_id, turn, role, parts: array of ``PART``): conv_id, turn, ``segment``,
    ``loss_start``, ``loss_end``, ``text_words``, ``expanded_tokens``, ``attachments``.

    * null parts, null texts and an empty list make an empty turn; a null role is an empty one; null ids and turns stay
    * control strings and placeholders inside texts are escaped, reversibly; very long texts are formatted whole
    * repeated rows and equal turn numbers each make a segment; an empty table makes none
    * other columns play no part, whatever their names; an unknown kind of part is an error
    """
    rows = turns.select("conv_id", "turn", "role", "parts", F.coalesce(F.col("role").isin(*trained_roles), F.lit(False)).alias("trained"))
    ids = ", ".join(f"{c} {turns.schema[c].dataType.simpleString()}" for c in ("conv_id", "turn"))
    return rows.mapInArrow(_segments, f"{ids}, {SEGMENT}")


_DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Reading:
    """One conversation while its segments pass by."""

    def __init__(self, conv):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, segment: str, start: int, end: int) -> None:
        self.chars += len(segment)
        for role, raw in parse_segments(segment):
            self.turns += 1
            self.all.update(f"{role}\n{unescape(raw)}\n".encode("utf-8", "surrogatepass"))
        if end > start:
            text = unescape(segment[start:end])
            self.loss_chars += len(text)
            self.loss.update(text.encode("utf-8", "surrogatepass"))

    def row(self):
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches):
    now, out, kind = None, [], None

    def flush():
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
        out.clear()
        return batch

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "loss_start", "loss_end"))
        for conv, segment, start, end in zip(*columns):
            if now is None or now.conv != conv:
                if now is not None:
                    out.append(now.row())
                now = _Reading(conv)
            now.take(segment, start, end)
        if len(out) >= 1000:
            yield flush()
    if now is not None:
        out.append(now.row())
    if out:
        yield flush()


def read_back(segments: DataFrame) -> DataFrame:
    """Per conversation, parsed from its segments in turn order (equal turns by text): ``n_turns``, ``turns_sha256`` (role,
    line feed, text, line feed per turn), ``loss_chars`` and ``loss_sha256`` of the unescaped text under the loss
    mask, ``formatted_chars``.

    A digest needs a conversation's turns one after another, so a task streams over them; it holds one batch and
    one hash state, however long a conversation is."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    ordered = segments.select("conv_id", "turn", "segment", "loss_start", "loss_end") \
        .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.mapInArrow(_read, f"conv_id {kind}, {_DIGEST}")
