"""Packing of token sequences by the sum-of-squares rule, online within each task.

A document longer than a window first fills whole windows. What remains of it goes where the
sum over all fill levels of the squared number of open windows at that level becomes
smallest; the numbers stand in one array indexed by level. The rule keeps the open windows
spread over the levels, so that most remainders find a window that they fill exactly. At the
end of a task the emptiest open windows are cut up to fill the fullest, so that each task
pads at most one window. A task needs no other task's rows: nothing is shuffled, and a task
that is run again on the same rows packs them in the same way.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common

WINDOW = 2048
END_ID = 1
VOCABULARY = "byte_bpe_50k.json"
_SEQUENCES_A_TASK = 1 << 33


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = (chr(256 + k) for k in range(256))
    return [chr(b) if b in shown else next(hidden) for b in range(256)]


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class _Words(dict):
    """word -> the bytes of its ids, with a fixed text before it; forgotten when too many."""

    def __init__(self, before: str, encode, limit: int):
        super().__init__()
        self.before, self.encode, self.limit = before, encode, limit

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = array("I", self.encode(self.before + word)).tobytes()
        return found


class WordEncoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, as the tokenizers library
    gives them for a byte-level vocabulary file.

    The pattern of such a file never joins across a single space or line feed that stands
    between two other characters, so a text of such is encoded word by word, and each word with
    the space before it is encoded once and remembered. Any other text goes to the library
    whole. New words go to tiktoken, with the file's own vocabulary as ranks, which gives the
    same ids for a word in a third of the time.
    """

    #: White space other than the space and the line feed.
    OTHER_SPACE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str, limit: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        raw = {symbol: bytes([b]) for b, symbol in enumerate(byte_alphabet())}
        ranks = {
            b"".join(map(raw.__getitem__, token)): k
            for token, k in self.tokenizer.get_vocab(with_added_tokens=False).items()
            if token not in added
        }
        quick = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bare = _Words("", quick.encode_ordinary, limit // 6)
        self.spaced = _Words(" ", quick.encode_ordinary, limit)
        self.line = self.whole("\n")
        self.apart = [*self.OTHER_SPACE, "  ", "\n\n", " \n", "\n ", *added]

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        bare, spaced = self.bare, self.spaced.__getitem__
        for text in texts:
            if not text:
                yield b""
            elif text[0] in " \n" or text[-1] in " \n" or any(x in text for x in self.apart):
                yield self.whole(text)
            else:
                lines = [x.split(" ") for x in text.split("\n")]
                yield self.line.join([bare[x[0]] + b"".join(map(spaced, x[1:])) for x in lines])


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Online packing into windows; `placed` gets (piece, window, offset) for every piece of a
    window once no more goes into it. A piece is [key, start, length]."""

    def __init__(self, window: int = WINDOW):
        self.window, self.next, self.placed = window, 0, []
        self.open: list[list[list]] = [[] for _ in range(window)]
        self.count = np.zeros(window + 1, np.int64)

    def _close(self, pieces: list[list]) -> None:
        offset = 0
        for piece in pieces:
            self.placed.append((piece, self.next, offset))
            offset += piece[2]
        self.next += 1

    def level_for(self, size: int) -> int:
        """The level (0: a new window) whose choice leaves the smallest sum of squares; of
        equals the fullest."""
        n, w = self.count, self.window
        if size == w:
            return 0
        after = 2 * n[size:w] + 1  # level h + size gains a window
        cost = np.concatenate((after, [0])) + np.concatenate(([0], 1 - 2 * n[1 : w - size + 1]))
        cost[1:][n[1 : w - size + 1] == 0] = np.iinfo(np.int64).max
        return w - size - int(np.argmin(cost[::-1]))

    def add(self, key, length: int) -> None:
        start = 0
        while length - start >= self.window:
            self._close([[key, start, self.window]])
            start += self.window
        if size := length - start:
            level = self.level_for(size)
            pieces = [] if not level else self.open[level].pop()
            self.count[level] -= bool(level)
            pieces.append([key, start, size])
            if level + size == self.window:
                self._close(pieces)
            else:
                self.open[level + size].append(pieces)
                self.count[level + size] += 1

    def finish(self) -> None:
        """Cut the emptiest open windows up to fill the fullest; one may stay unfilled."""
        rest = [(level, pieces) for level in range(self.window) for pieces in self.open[level]]
        low, high = 0, len(rest) - 1
        while low < high:
            level, pieces = rest[high]
            room = self.window - level
            while room and low < high:
                size, donor = rest[low]
                piece = donor.pop()
                take = min(room, piece[2])
                if take < piece[2]:
                    donor.append([piece[0], piece[1], piece[2] - take])
                pieces.append([piece[0], piece[1] + piece[2] - take, take])
                rest[low] = (size - take, donor)
                room -= take
                low += not donor
            if room:
                rest[high] = (self.window - room, pieces)
                break
            self._close(pieces)
            high -= 1
        if low <= high:
            self._close(rest[high][1])
        self.open, self.count = [[] for _ in range(self.window)], np.zeros(self.window + 1, np.int64)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the single id `end_id`. Rows that repeat a doc_id, or have none,
    are packed each for itself. An empty table gives an empty one.
    """
    end = np.array([end_id], "<u4").tobytes()
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_at = path or vocabulary_path(VOCABULARY)  # on the machine that runs the task
        packer, base = Packer(window), TaskContext.get().partitionId() * _SEQUENCES_A_TASK
        held: dict[int, tuple] = {}  # rows with pieces in open windows: doc_id, ids, pieces left
        row = 0

        def out(placed: list) -> pa.RecordBatch:
            columns: list[list] = [[] for _ in names]
            for (key, start, size), sequence, offset in placed:
                doc_id, ids, total, left = held[key]
                part = crc32(memoryview(ids)[4 * start : 4 * (start + size)])
                for column, value in zip(columns, (doc_id, start, size, part, total, base + sequence, offset), strict=True):
                    column.append(value)
                left -= size
                if left:
                    held[key] = (doc_id, ids, total, left)
                else:
                    del held[key]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        for ids, texts in common.chunks(batches, 2 << 20):
            for doc_id, found in zip(ids, encoder(found_at).encode(texts), strict=True):
                found += end
                held[row] = (doc_id, found, len(found) // 4, len(found) // 4)
                packer.add(row, len(found) // 4)
                row += 1
            if packer.placed:
                yield out(packer.placed)
                packer.placed = []
        packer.finish()
        if packer.placed:
            yield out(packer.placed)

    return common.id_and_text(docs).mapInArrow(run, SCHEMA)
