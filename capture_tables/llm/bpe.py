"""BPE by a streaming transducer with bounded lookahead, and an incremental decoder.

A prefix of a word has one encoding, and the last token of that encoding is what the
transducer keeps for each position: the token t that ends there, whose own symbols merge to t
alone, and before which the encoding of what stands to its left ends in a token that does
not merge with it. A token that starts more than the longest token's length before the
newest position can't change any more, since every longer prefix's encoding passes through
one of the positions between; that length, taken from the merge list, is the sufficient
lookahead. Tokens are emitted as soon as all those positions agree on them, so that a word
of any length needs a window of fixed size.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common
from .packing import byte_alphabet, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: How the word vocabulary's file cuts a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands for the word end inside this module, after the last symbol of a word.
_END = "\n"
_NEVER = 1 << 60


class Transducer:
    """Word (byte alphabet string) -> token ids, by the merge list of a vocabulary."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        inner = lambda token: token.removesuffix(suffix) + _END if token.endswith(suffix) and suffix else token
        self.ids = {inner(token): k for token, k in vocab.items()}
        pairs = (tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in merges)
        self.rank = {(inner(a), inner(b)): k for k, (a, b) in enumerate(pairs)}
        self.end = _END if suffix else ""
        self.symbols_of = lambda token: [*token[: -1 - len(_END)], token[-1 - len(_END) :]] if token.endswith(_END) else [*token]
        self.length = {token: len(token) - token.endswith(_END) for token in self.ids}
        reach = {a + b for a, b in self.rank} | {token for token in self.ids if self.length[token] == 1}
        self.tokens = {token for token in reach if token in self.ids and self.merged(self.symbols_of(token)) == [token]}
        #: Symbols that may have to be seen behind a token's first before it is certain.
        self.lookahead = max((self.length[token] for token in self.tokens), default=1)
        self.made = {a + b: (k, a, b) for (a, b), k in self.rank.items()}
        if len(self.made) < len(self.rank):
            raise ValueError("a token has two merges")
        self._left: dict[str, list[tuple[str, int]]] = {}
        self._right: dict[str, list[tuple[str, int]]] = {}
        self._apart: dict[int, bool] = {}
        #: Finds all tokens of a word; one that ends it has the end mark as its last symbol.
        self.automaton = ahocorasick.Automaton()
        self.token_of = {self.ids[token]: token for token in self.tokens}
        for token in self.tokens:
            self.automaton.add_word(token, (self.length[token], token.endswith(_END), self.ids[token]))
        self.automaton.make_automaton()

    def merged(self, symbols: list[str]) -> list[str]:
        """Merges by rank, leftmost first: the definition that the transducer must meet."""
        symbols = list(symbols)
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, 1 << 60) for pair in zip(symbols, symbols[1:], strict=False)]
            best = min(ranks)
            if best == 1 << 60:
                break
            first, second = symbols[k := ranks.index(best)], symbols[k + 1]
            out, k = [], 0
            while k < len(symbols):
                if symbols[k] == first and k + 1 < len(symbols) and symbols[k + 1] == second:
                    out.append(first + second)
                    k += 2
                else:
                    out.append(symbols[k])
                    k += 1
            symbols = out
        return symbols

    def _spine(self, token: str, side: int, known: dict) -> list[tuple[str, int]]:
        """What stands at the token's left (0) or right (1) edge while it is being merged,
        smallest first, each with the rank of the merge that ends it."""
        found = known.get(token)
        if found is None:
            part, found = token, [(token, _NEVER)]
            while part in self.made:
                rank, *halves = self.made[part]
                part = halves[side]
                found.append((part, rank))
            known[token] = found = found[::-1]
        return found

    def apart(self, a: str, b: str) -> bool:
        """True if tokens a and b stay as they are when one follows the other: at no time has
        the pair across their border a merge that comes before those inside a and b. Of
        merges of one rank the leftmost comes first."""
        left, right = self._spine(a, 1, self._right), self._spine(b, 0, self._left)
        i = j = 0
        found = True
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            rank = self.rank.get((x, y), _NEVER)
            if rank < x_ends and rank <= y_ends:
                found = False
                break
            if x_ends == y_ends == _NEVER:
                break
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1
        return found

    def _apart_of(self, key: int) -> bool:
        """`apart` of two token ids, packed in one number, remembered."""
        if len(self._apart) > 600_000:
            self._apart.clear()
        found = self._apart[key] = self.apart(self.token_of[key >> 32], self.token_of[key & 0xFFFFFFFF])
        return found

    def encode(self, word: str) -> list[int]:
        """Ids of one word; one longer than the window is streamed."""
        n = len(word)
        if n > 4 * self.lookahead:
            return list(self.stream(word))
        ended, known = bool(self.end), self._apart
        last, before = [-1] * (n + 1), [0] * (n + 1)
        for at, (length, ends, token) in self.automaton.iter(word + self.end):
            p = at + 1 - ends
            if last[p] >= 0 or p == n and ends is not ended:
                continue
            start = p - length
            if start:
                left = last[start]
                if left < 0:
                    continue
                key = left << 32 | token
                apart = known.get(key)
                if apart is None:
                    apart = self._apart_of(key)
                if not apart:
                    continue
            last[p], before[p] = token, start
        out, p = [], n
        while p:
            out.append(last[p])
            p = before[p]
        return out[::-1]

    def stream(self, word: Iterable[str]) -> Iterator[int]:
        """Ids of one word, given symbol by symbol, each emitted once it is certain."""
        window, tokens, size = self.lookahead, self.tokens, 0
        text, base = "", 0  # text[0] is symbol number `base`
        last: dict[int, tuple[str, int]] = {}  # position -> last token of the prefix, its start
        sent = 0  # symbols whose tokens were emitted

        def step(p: int, end: str) -> None:
            for start in range(max(sent, p - window), p):
                token = text[start - base : p - base] + end
                if token in tokens and (not start or start == sent and start not in last or start in last and self.apart(last[start][0], token)):
                    last[p] = (token, start)
                    return

        def chain(p: int) -> list[int]:
            """Token ends of the prefix's encoding, from the first not emitted to p."""
            ends = []
            while p > sent:
                ends.append(p)
                p = last[p][1]
            return ends[::-1]

        pending = None
        for symbol in word:
            if pending is not None:
                text += pending
                size += 1
                step(size, "")
                if size - sent > 4 * window:
                    chains = [chain(p) for p in range(size - window, size + 1) if p in last]
                    common_ends = []
                    for ends in zip(*chains, strict=False):
                        if len(set(ends)) > 1:
                            break
                        common_ends.append(ends[0])
                    for p in common_ends:
                        yield self.ids[last[p][0]]
                    if common_ends:
                        sent = common_ends[-1]
                        text, base = text[sent - base :], sent
                        last = {p: x for p, x in last.items() if p >= sent}
            pending = symbol
        if pending is not None:
            text += pending
            size += 1
            step(size, self.end)
            for p in chain(size):
                yield self.ids[last[p][0]]


class Decoder:
    """Token ids -> text, one id at a time.

    `stream` gives the tokens as the vocabulary writes them: a vocabulary file that names no
    decoder has its tokens joined with spaces by whoever joins them. `text` is the state
    machine that goes back to the text: a token's bytes are fed to a UTF-8 decoder that keeps
    an unfinished character until a later token completes it, and a word's end is a space.
    """

    def __init__(self, vocab: dict[str, int], suffix: str = ""):
        self.tokens = {k: token for token, k in vocab.items()}
        self.suffix = suffix
        self.bytes = {symbol: b for b, symbol in enumerate(byte_alphabet())}

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        return map(self.tokens.__getitem__, filter(self.tokens.__contains__, ids))

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        state = codecs.getincrementaldecoder("utf-8")("replace")
        for token in self.stream(ids):
            ends = bool(self.suffix) and token.endswith(self.suffix)
            body = token[: -len(self.suffix)] if ends else token
            found = state.decode(bytes(self.bytes[c] for c in body if c in self.bytes))
            if found or ends:
                yield found + " " * ends
        if rest := state.decode(b"", True):
            yield rest


class _Known(dict):
    """What was translated already; it is forgotten when there is too much of it."""

    def __init__(self, translate, limit: int):
        super().__init__()
        self.translate, self.limit = translate, limit

    def __missing__(self, text: str):
        if len(self) >= self.limit:
            self.clear()
        found = self[text] = self.translate(text)
        return found


class WordBpe:
    """Texts -> (ids as bytes, decoded text) with each different word translated once."""

    def __init__(self, path: str, limit: int = 400_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        vocab = model["vocab"] | {t["content"]: t["id"] for t in added}
        self.transducer = Transducer(model["vocab"], model["merges"], model["end_of_word_suffix"] or "")
        self.decoder = Decoder(vocab, model["end_of_word_suffix"] or "")
        self.special = {t["content"]: t["id"] for t in added}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if added else None
        self.cut = regex.compile(WORD_PATTERN).findall
        self.space = regex.compile(r"\s")
        self.alphabet = byte_alphabet()
        self.pieces = _Known(self._piece, limit)
        self.known = _Known(self._word, limit)

    def _piece(self, piece: str) -> tuple[bytes, str]:
        word = piece if piece.isascii() and piece.isprintable() else "".join([self.alphabet[b] for b in piece.encode("utf-8", "surrogatepass")])
        ids = self.transducer.encode(word)
        return array("I", ids).tobytes(), " ".join(self.decoder.stream(ids))

    def _word(self, word: str) -> tuple[bytes, str]:
        if word.isascii() and word.isalpha():
            return self.pieces[word]
        found = [self.pieces[piece] for piece in self.cut(word)]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])

    def _plain(self, text: str) -> tuple[bytes, str]:
        text = text.replace("Σ", "σ") if "Σ" in text else text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = text.lower()
        words = text.split() if text.isascii() and text.isprintable() else self.space.split(text)
        found = list(map(self.known.__getitem__, words))
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])

    def translate(self, text: str) -> tuple[bytes, str]:
        if not text:
            return b"", ""
        parts = self.special_pattern.split(text) if self.special_pattern and "<|" in text else [text]
        found = [(array("I", [self.special[x]]).tobytes(), x) if x in self.special else self._plain(x) for x in parts if x]
        return b"".join([x[0] for x in found]), " ".join([x[1] for x in found if x[0]])


_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def encode(docs: DataFrame, path: str | None = None, with_texts: bool = False) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; `with_texts` adds
    ids (array of ints) and decoded. A null or empty text has no tokens and decodes to the
    empty text. Rows that repeat a doc_id are encoded each; an empty table gives an empty one."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        translate = model(path or vocabulary_path(VOCABULARY)).translate  # a file of the machine that runs the task
        for ids, texts in common.chunks(batches):
            rows = [translate(t) for t in texts]
            columns = [
                pa.array(ids, pa.int64()),
                pa.array([len(r[0]) // 4 for r in rows], pa.int64()),
                pa.array([sha256(r[0]).hexdigest() for r in rows]),
                pa.array([sha256(r[1].encode("utf-8", "surrogatepass")).hexdigest() for r in rows]),
            ]
            more = []
            if with_texts:
                more = [pa.array([np.frombuffer(r[0], "<u4").astype(np.int32) for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows])]
            yield pa.RecordBatch.from_arrays(columns + more, names + ["ids", "decoded"] * bool(more))

    return common.id_and_text(docs).mapInArrow(run, schema + ", ids array<int>, decoded string" * with_texts)
