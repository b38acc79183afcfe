"""Chat formatting by schema fingerprints.

Records come in many layouts: a prompt and its answer, an instruction with its input and output, a
list of messages under various names, or one row for each turn. The nested field paths of a record
(`messages[].role`, `prompt`) are hashed to a fingerprint, and the fingerprint selects a declarative
mapping (`Layout`) to canonical turns. Roots that no layout names are metadata and stay out of the
fingerprint. Records of no known layout are kept, as one row without role and text, with their
fingerprint, so that a mapping can be added.

The template writes a turn as `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed.
Inside roles and texts a backslash is doubled and `<|` becomes `<\\|` (in roles a line feed `\\n`), so that
control strings stand only where the template puts them, and all of it can be undone.

Conversations are dealt by ranges of (conv_id, turn) and written in pieces of whole turns, so that a
conversation of any length is spread over many tasks. Reading back takes a whole conversation where
it stands; only those that were cut move, piece by piece, and are read as they come.

A null text is an empty one, a null role an empty name. Records of one turn number stay together and
follow by their hashes; repeated rows are turns of their own. Rows without conv_id are one
conversation, without turn they come first. Other columns are metadata, unless a layout names them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

START, END = "<|im_start|>", "<|im_end|>\n"
#: The text after this role is learnt.
LEARNT = "assistant"
#: Characters of a piece, after which the next turn begins a new one.
PIECE = 1 << 20

#: Names of roles in published layouts -> canonical ones. Fixed values.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """A mapping to turns. `turns`: (role, paths of the texts that make it up), turns without any of
    their texts left out; or `each`: the path of a list whose elements have `role` and `text`; or
    neither: the record is a turn itself, with `role` and `text`. `optional` paths may be absent.
    With `renamed`, roles get their canonical names."""

    name: str
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    each: str = ""
    role: str = ""
    text: str = ""
    optional: tuple[str, ...] = ()
    renamed: bool = False

    def paths(self) -> frozenset[str]:
        if self.turns:
            return frozenset(p for _, texts in self.turns for p in texts)
        own = [f"{self.each}[]", f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"] if self.each else [self.role, self.text]
        return frozenset(own)

    def fingerprints(self) -> list[str]:
        """Those of all records that it fits: with and without each optional path."""
        sets = [self.paths()]
        for path in self.optional:
            sets += [s - {path} for s in sets]
        return [fingerprint(s) for s in sets]


@dataclass(frozen=True)
class Layouts:
    known: tuple[Layout, ...] = field(default_factory=lambda: STANDARD)

    def roots(self) -> frozenset[str]:
        return frozenset(_root(p) for layout in self.known for p in layout.paths())

    def by_fingerprint(self) -> dict[str, Layout]:
        found: dict[str, Layout] = {}
        for layout in self.known:
            for key in layout.fingerprints():
                if key in found and found[key] != layout:
                    raise ValueError(f"layouts {found[key].name} and {layout.name} have one fingerprint")
                found[key] = layout
        return found


STANDARD = (
    Layout("turn rows", role="role", text="text", optional=("text",)),
    Layout("messages", each="messages", role="role", text="content", optional=("messages[].content",)),
    Layout("conversations", each="conversations", role="from", text="value", optional=("conversations[].value",), renamed=True),
    Layout("prompt and completion", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",))), optional=("system",)),
    Layout("prompt and response", turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))), optional=("system",)),
    Layout("instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))), optional=("system", "input")),
    Layout("question and answer", turns=(("user", ("question",)), ("assistant", ("answer",)))),
)


def _root(path: str) -> str:
    return path.split(".")[0].removesuffix("[]")


def field_paths(value, roots: frozenset[str] | None = None, at: str = "") -> set[str]:
    """The paths of all fields; lists add `[]`, an empty list that alone."""
    found: set[str] = set()
    if isinstance(value, dict):
        for name, inner in value.items():
            if roots is None or at or name in roots:
                found |= field_paths(inner, roots, f"{at}.{name}" if at else name)
    elif isinstance(value, list):
        found.add(f"{at}[]")
        for inner in value:
            if isinstance(inner, dict | list):
                found |= field_paths(inner, roots, f"{at}[]")
    elif at:
        found.add(at)
    return found


def fingerprint(paths) -> str:
    """16 hexadecimal digits that stand for a set of field paths."""
    return blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


def _said(value) -> str:
    return value if isinstance(value, str) else "" if value is None else json.dumps(value, ensure_ascii=False)


def _inside(record: dict, path: str):
    for name in path.split("."):
        record = record.get(name) if isinstance(record, dict) else None
    return record


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """(role, text) of a record's turns by its layout."""
    if layout.turns:
        found = [(role, [_said(t) for p in paths if (t := _inside(record, p)) is not None]) for role, paths in layout.turns]
        return [(role, "\n\n".join(t for t in texts if t)) for role, texts in found if texts]
    rows = _inside(record, layout.each) if layout.each else [record]
    names = [(_said(r.get(layout.role)), _said(r.get(layout.text))) for r in rows if isinstance(r, dict)]
    return [(ROLES.get(role, role), text) for role, text in names] if layout.renamed else names


TURNS = "conv_id long, turn long, record long, pos int, role string, text string, layout string, fingerprint string"


def records(table: DataFrame) -> DataFrame:
    """conv_id, each row as a JSON record of its own, and turn. A table without column turn has none."""
    turn = F.col("turn").cast("long") if "turn" in table.columns else F.lit(None).cast("long")
    record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return table.select(F.col("conv_id").cast("long").alias("conv_id"), record.alias("record"), turn.alias("turn"))


def canonical(rows: DataFrame, layouts: Layouts | None = None) -> DataFrame:
    """TURNS of records (conv_id, record, turn): pos counts within a record."""
    layouts = layouts or Layouts()
    roots = layouts.roots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = layouts.by_fingerprint()
        key_of = cache(fingerprint)
        for batch in slices(batches):
            out: list[tuple] = []
            for conv, record, turn, hashed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                value = _parsed(record)
                key = key_of(frozenset(field_paths(value, roots)))
                layout = known.get(key)
                if layout is None:
                    out.append((conv, turn, hashed, 0, None, None, None, key))
                else:
                    out += [(conv, turn, hashed, k, role, text, layout.name, key) for k, (role, text) in enumerate(turns_of(value, layout))]
            yield _batch(out, [*[pa.int64()] * 3, pa.int32(), *[pa.string()] * 4], ["conv_id", "turn", "record", "pos", "role", "text", "layout", "fingerprint"])

    return rows.select("conv_id", "record", "turn", F.xxhash64("record").alias("hashed")).mapInArrow(run, TURNS)


def _parsed(record: str | None) -> dict:
    try:
        value = json.loads(record) if record else {}
    except ValueError:
        return {}
    return value if isinstance(value, dict) else {}


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)


def escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|") if "\\" in text or "<|" in text else text


def unescaped(text: str) -> str:
    if "\\" not in text:
        return text
    parts = [p.replace("\\|", "|").replace("\\n", "\n") for p in text.split("\\\\")]
    return "\\".join(parts)


def written(role: str, text: str) -> tuple[str, str, str]:
    """A turn as the template writes it: what comes before its text, the text, what comes after."""
    return f"{START}{escaped(role).replace('\n', '\\n')}\n", escaped(text), END


def read(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) of each turn, from what the template wrote."""
    turns = []
    for turn in formatted.split(START)[1:]:
        role, _, rest = turn.partition("\n")
        turns.append((unescaped(role), unescaped(rest.removesuffix(END))))
    return turns


PIECES = "conv_id long, part int, piece int, whole boolean, n_turns long, formatted string, loss array<struct<start: int, end: int>>"


class _Piece:
    """Turns of one conversation as they are written, from its first turn in this task on or not."""

    def __init__(self, conv: int | None, first: bool):
        self.conv, self.first, self.texts, self.spans, self.size, self.turns = conv, first, [], [], 0, 0

    def add(self, role: str, text: str) -> None:
        before, inside, after = written(role, text)
        start = self.size + len(before)
        if role == LEARNT:
            self.spans.append({"start": start, "end": start + len(inside)})
        self.texts += (before, inside, after)
        self.size, self.turns = start + len(inside) + len(after), self.turns + 1


def _write(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    names = ["conv_id", "part", "piece", "whole", "n_turns", "formatted", "loss"]
    done: list[tuple] = []
    piece, number, size, seen = None, 0, 0, False  # seen: a conversation ended before this piece's

    def row(whole: bool) -> tuple:
        return piece.conv, part, number, whole, piece.turns, "".join(piece.texts), piece.spans

    for batch in slices(batches):
        for conv, text, role in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            role, text = role or "", text or ""
            new = piece is None or piece.conv != conv
            if piece is not None and (new or piece.size + len(text) > most):
                done.append(row(new and seen and piece.first))
                number, size, seen = number + 1, size + piece.size, seen or new
            if new or piece.size + len(text) > most:
                piece = _Piece(conv, new)
            piece.add(role, text)
            if size > most:
                yield _batch(done, kinds, names)
                done, size = [], 0
    if piece is not None:
        done.append(row(False))  # it may go on in the next task
    yield _batch(done, kinds, names)


def formatted(turns: DataFrame, most: int = PIECE) -> DataFrame:
    """PIECES of the conversations, of up to `most` characters or one turn: `formatted`, the characters in it under the loss mask (escaped, as
    they stand), and whether it is sure to be all of its conversation. A conversation's pieces follow
    by (part, piece). Rows of no known layout say nothing."""
    said = turns.where("role is not null or text is not null or layout is not null")
    dealt = said.select("conv_id", "role", "text", "turn", "record", "pos").repartitionByRange("conv_id", "turn")
    return dealt.sortWithinPartitions("conv_id", "turn", "record", "pos").select("conv_id", "text", "role").mapInArrow(lambda batches: _write(batches, most), PIECES)


CONVERSATIONS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_NAMES = [c.split()[0] for c in CONVERSATIONS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


class _Reading:
    """A conversation as it is read, piece by piece."""

    def __init__(self, conv: int | None):
        self.conv, self.n_turns, self.loss_chars, self.chars, self.turns, self.loss = conv, 0, 0, 0, sha256(), sha256()

    def add(self, formatted: str, spans: list[dict]) -> _Reading:
        for role, text in read(formatted):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for span in spans:
            text = unescaped(formatted[span["start"] : span["end"]])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.chars += len(formatted)
        return self

    def row(self) -> tuple:
        return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CONVERSATIONS for whole ones; pieces of the others pass."""
    kinds = [*_KINDS, pa.int32(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
    for batch in slices(batches):
        out = []
        for conv, text, spans, whole, part, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            out.append((*_Reading(conv).add(text, spans).row(), part, piece, None, None) if whole else (conv, *[None] * 5, part, piece, text, spans))
        yield _batch(out, kinds, [*_NAMES, "part", "piece", "formatted", "loss"])


def _read_cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of CONVERSATIONS from pieces in order; finished ones pass."""
    reading = None
    for batch in batches:
        out = []
        for formatted, spans, *done in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if reading and (formatted is None or done[0] != reading.conv):
                out.append(reading.row())
                reading = None
            if formatted is None:
                out.append(tuple(done))
            else:
                reading = (reading or _Reading(done[0])).add(formatted, spans)
        yield _batch(out, _KINDS, _NAMES)
    if reading:
        yield _batch([reading.row()], _KINDS, _NAMES)


def read_back(pieces: DataFrame) -> DataFrame:
    """CONVERSATIONS, from the pieces alone. Of those that were not cut only the result moves."""
    first = pieces.select("conv_id", "formatted", "loss", "whole", "part", "piece")
    done = first.mapInArrow(_read_whole, CONVERSATIONS + ", part int, piece int, formatted string, loss array<struct<start: int, end: int>>")
    ordered = done.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return ordered.select("formatted", "loss", *_NAMES).mapInArrow(_read_cut, CONVERSATIONS)
