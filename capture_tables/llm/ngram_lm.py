"""Language-model scores from an Elias-Fano trie of word n-grams.

The model adds the counts of a trigram and of its shorter forms, with weights:
P(w | u v) = (c(u v w) + B c(v w) + G p(w)) / (c(u v) + B c(v) + G), with the unigram
p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)). Its numerator says how often w follows, and its
denominator how often the context stands, so that both may be found apart: where all
occurrences of w are, the counts of w, v w and u v w are known, and those of w and v w are
also what the denominator of the next word needs. A text's score is the sum of both.

Training words are counted first, by word. Then each occurrence of a word goes, with the two
words before it, to the shard of the word's hash; of a word so frequent that it would overfill
its shard, to the shard of the hash of it and the word before it. Occurrences travel in
packed form, each different word, pair and triple of a batch of texts once. A shard numbers
its words, counts the training texts' n-grams and builds its part of the trie: a level of
words, below each the words that stand before it, and below those the words before them. Words
are told apart by 64 bits of hash, those before one word by 40 and those before one pair by 32:
of a million different words before the same word one pair in two such words is taken for one,
and of ten thousand before the same pair one in 86 such pairs. All
levels are monotone sequences in Elias-Fano form, with pointers from one to the next likewise,
and two bytes for each entry's quantised logarithm. They lie in a memory-mapped file for as
long as the shard's task runs. A trigram is looked up word by word, each by binary search
between its parent's two pointers; where a word is not there, what was found so far counts.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Weights of the bigram's count and of the unigram, in observations of the trigram.
PAIR_WEIGHT, WORD_WEIGHT = 0.003, 10.0
#: Bytes of text in a batch, and words in a shard on average.
BATCH, SHARD_WORDS = 12 << 20, 1_000_000
#: Words that are dealt by pairs: those with more occurrences than this share of a shard and of
#: the corpus; so there are no more than HOT of them.
HOT = 1_000_000
#: Bytes of text counted at once, and different words that a task holds before handing them on.
CHUNK, HELD = 1 << 20, 2_000_000
BEFORE, SECOND = np.uint64(40), np.uint64(32)
END, BEGIN = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


class EliasFano:
    """A monotone sequence of unsigned numbers: low bits packed, high bits as a bit string."""

    def __init__(self, values: np.ndarray, keep):
        """keep(array) stores an array and returns it, memory-mapped or not."""
        values = values.astype(np.uint64)
        n = self.n = len(values)
        top = int(values[-1]) if n else 0
        self.low_bits = max(0, (top // max(1, n)).bit_length() - 1)
        high = values >> np.uint64(self.low_bits)
        bits = np.zeros((int(high[-1]) if n else 0) + n + 1, np.uint8)
        bits[(high + np.arange(n, dtype=np.uint64)).astype(np.int64)] = 1
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8)))
        self.high = keep(packed.view("<u8"))
        ones = np.bitwise_count(self.high).astype(np.int64)
        self.before = keep((np.cumsum(ones) - ones).astype(np.uint32))
        low = (values & np.uint64((1 << self.low_bits) - 1))[:, None] >> np.arange(self.low_bits, dtype=np.uint64)[None, :] & np.uint64(1)
        flat = np.packbits(low.astype(np.uint8).ravel(), bitorder="little")
        self.low = keep(np.concatenate((flat, np.zeros(16, np.uint8))))

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        """The values at positions `at`."""
        at = np.asarray(at, np.int64)
        word = np.searchsorted(self.before, at.astype(np.uint32), "right") - 1
        rest = at - self.before[word]
        bits = self.high[word]
        place = np.zeros(len(at), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # the bit that holds one number `rest` of this word
            part = bits >> place.astype(np.uint64) & np.uint64((1 << width) - 1)
            ones = np.bitwise_count(part).astype(np.int64)
            over = rest >= ones
            rest -= np.where(over, ones, 0)
            place += np.where(over, width, 0)
        high = (word * 64 + place - at).astype(np.uint64)
        if not self.low_bits:
            return high
        first = at * self.low_bits
        byte, shift = first >> 3, (first & 7).astype(np.uint64)
        window = np.lib.stride_tricks.sliding_window_view(self.low, 8)[byte]
        pair = np.ascontiguousarray(window).view("<u8").ravel() >> shift
        spill = self.low[byte + 8].astype(np.uint64) << (np.uint64(63) - shift) << np.uint64(1)
        return high << np.uint64(self.low_bits) | (pair | spill) & np.uint64((1 << self.low_bits) - 1)

    def find(self, target: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first position in [low, high) whose value is not below the target, or high."""
        low, high = low.copy(), high.copy()
        while len(open_ := np.flatnonzero(low < high)):
            middle = (low[open_] + high[open_]) >> 1
            below = self[middle] < target[open_]
            low[open_] = np.where(below, middle + 1, low[open_])
            high[open_] = np.where(below, high[open_], middle)
        return low


class Trie:
    """Words, the words before them and the words before those, with quantised logarithms of
    the model's numerators at every level, and of its denominators at the first two."""

    def __init__(self, c_word, pair, c_pair, triple, c_triple, total: float, pair_weight: float, word_weight: float):
        """c_word: counts by word number; pair: sorted `word << BEFORE | before`; triple: sorted
        `place in pair << SECOND | before`; c_pair, c_triple: their counts."""
        self.file = tempfile.TemporaryFile()
        share, of_pair, of_triple = word_weight * (c_word + 0.5) / total, (pair >> BEFORE).astype(np.int64), (triple >> SECOND).astype(np.int64)
        numerator = pair_weight * c_pair + share[of_pair]
        self.unknown = (np.log10(word_weight * 0.5 / total), -np.log10(word_weight))
        word, held, deep = np.flatnonzero(c_word > 0), np.flatnonzero(c_pair > 0), np.flatnonzero(c_triple > 0)
        self.words = EliasFano(word, self._keep)
        place = lambda counts: np.cumsum(counts > 0) - 1
        self.pairs, self.to_pairs = self._level(place(c_word)[of_pair[held]], pair[held], BEFORE, len(word))
        self.triples, self.to_triples = self._level(place(c_pair)[of_triple[deep]], triple[deep], SECOND, len(held))
        self.numerators = [self._quantised(np.log10(x)) for x in (share[word], numerator[held], c_triple[deep] + numerator[of_triple[deep]])]
        inner = pair_weight * c_word
        self.denominators = [self._quantised(-np.log10(x)) for x in (inner[word] + word_weight, c_pair[held] + inner[of_pair[held]] + word_weight)]

    def _level(self, parent: np.ndarray, keys: np.ndarray, bits: np.uint64, parents: int) -> tuple[EliasFano, EliasFano]:
        """What is below the kth parent is written from k * 2^bits on: one monotone sequence."""
        below = keys & ((np.uint64(1) << bits) - np.uint64(1))
        return EliasFano(parent.astype(np.uint64) << bits | below, self._keep), EliasFano(np.searchsorted(parent, np.arange(parents + 1)), self._keep)

    def _quantised(self, values: np.ndarray) -> tuple[np.ndarray, float, float]:
        low = float(values.min()) if len(values) else 0.0
        step = max((float(values.max()) - low) / 65535, 1e-12) if len(values) else 1.0
        return self._keep(np.round((values - low) / step).astype(np.uint16)), low, step

    def _keep(self, values: np.ndarray) -> np.ndarray:
        values = np.ascontiguousarray(values)
        if not values.nbytes:
            return values
        offset = self.file.seek(0, os.SEEK_END)
        offset = self.file.seek(offset + -offset % 4096)
        self.file.write(values.tobytes())
        self.file.flush()
        return np.memmap(self.file, values.dtype, "r", offset, values.shape)

    @staticmethod
    def _value(codes: tuple[np.ndarray, float, float], at: np.ndarray) -> np.ndarray:
        return codes[0][at] * codes[2] + codes[1]

    def _below(self, level: EliasFano, pointers: EliasFano, parent: np.ndarray, keys: np.ndarray, bits: np.uint64) -> np.ndarray:
        """Where a key's lower bits stand below its parent (a place in the level above), or -1."""
        out = np.full(len(parent), -1, np.int64)
        known = np.flatnonzero(parent >= 0)
        if not len(known) or not level.n:
            return out
        above = parent[known]
        low, high = pointers[above].astype(np.int64), pointers[above + 1].astype(np.int64)
        target = above.astype(np.uint64) << bits | keys[known] & ((np.uint64(1) << bits) - np.uint64(1))
        place = level.find(target, low, high)
        hit = np.flatnonzero(place < high)
        hit = hit[level[place[hit]] == target[hit]]
        out[known[hit]] = place[hit]
        return out

    def look_up(self, pair: np.ndarray, triple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(logarithms of the numerators of the triples, of the denominators behind the pairs)."""
        wanted, sizes = np.unique(pair >> BEFORE, return_counts=True)
        at = self.words.find(wanted, np.zeros(len(wanted), np.int64), np.full(len(wanted), self.words.n))
        hit = np.flatnonzero(at < self.words.n)
        hit = hit[self.words[at[hit]] == wanted[hit]]
        first = np.full(len(wanted), -1, np.int64)
        first[hit] = at[hit]
        first = np.repeat(first, sizes)
        second = self._below(self.pairs, self.to_pairs, first, pair, BEFORE)
        numerator, denominator = np.full(len(pair), self.unknown[0]), np.full(len(pair), self.unknown[1])
        for k, place in enumerate((first, second)):
            held = place >= 0
            numerator[held], denominator[held] = self._value(self.numerators[k], place[held]), self._value(self.denominators[k], place[held])
        above = (triple >> SECOND).astype(np.int64)
        third = self._below(self.triples, self.to_triples, second[above], triple, SECOND)
        out, held = numerator[above], third >= 0
        out[held] = self._value(self.numerators[2], third[held])
        return out, denominator


def _planes(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, as many as the largest of them needs, with a header."""
    values = np.asarray(values).astype("<u8")
    width = max(1, (int(values.max(initial=0)).bit_length() + 7) // 8)
    return np.array([len(values), width], "<i8").tobytes() + np.ascontiguousarray(values.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(data: bytes, at: int) -> tuple[np.ndarray, int]:
    n, width = (int(x) for x in np.frombuffer(data, "<i8", 2, at))
    whole = np.zeros((n, 8), np.uint8)
    whole[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n).T
    return whole.view("<u8").ravel(), at + 16 + n * width


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n): how often training texts hold each word; and without word, all texts' words."""
    every, held, counts = 0, [], []

    def merged() -> tuple[np.ndarray, np.ndarray]:
        words, at = np.unique(np.concatenate(held), return_inverse=True)
        return words, np.bincount(at, np.concatenate(counts), len(words)).astype(np.int64)

    def rows(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(n)], ["word", "n"])

    for part in common.slices(batches, CHUNK):
        train = part.column(2).to_numpy(zero_copy_only=False)
        scan = common.Scan(part.column(1))
        every += len(scan) + part.num_rows
        words, n = np.unique(scan.hashes[np.repeat(train, scan.per_row())], return_counts=True)
        held.append(np.append(words, END))
        counts.append(np.append(n, train.sum()))
        if sum(map(len, held)) > 2 * HELD:
            words, n = merged()
            held, counts = [words], [n]
            if len(words) > HELD:
                yield rows(words, n)
                held, counts = [], []
    if held:
        words, n = merged()
        yield rows(words[n > 0], n[n > 0])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([every])], ["word", "n"])


def _in(values: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Where the values are in the sorted array `found`."""
    if not len(found):
        return np.zeros(len(values), bool)
    return found[np.minimum(np.searchsorted(found, values), len(found) - 1)] == values


def _routed(hot, shards: int):
    """Rows (shard, batch, kind, data): of each batch its texts, and the occurrences of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 24
        for part in common.slices(batches, BATCH):
            scan = common.Scan(part.column(1))
            sizes = scan.per_row() + 1
            ends = np.cumsum(sizes)
            every = np.full(ends[-1], END)
            inner = np.ones(ends[-1], bool)
            inner[ends - 1] = False
            every[inner] = scan.hashes
            del scan
            hashed, word = np.unique(every, return_inverse=True)
            del every, inner
            # numbered by shard, so that a sort by word is one by shard
            home = common.mix64(hashed) % np.uint64(shards)
            order = np.argsort(home, kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            hashed, home, word = np.append(hashed[order], BEGIN), home[order].astype(np.int64), rank[word]
            begin = len(home)
            before, second = np.empty_like(word), np.empty_like(word)
            before[1:], second[2:] = word[:-1], word[:-2]
            first = ends - sizes
            before[first] = second[first] = begin
            second[first[sizes > 1] + 1] = begin
            doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
            if len(hashed) < 1 << 21:
                order = np.argsort((word.astype(np.int64) << 42) + (before.astype(np.int64) << 21) + second)
            else:
                order = np.lexsort((second, before, word))
            word, before, second, doc = word[order], before[order], second[order], doc[order]
            where = home[word]
            if (split := np.flatnonzero(_in(hashed[:-1], hot.value[0])[word])).size:
                where[split] = (common.mix64(hashed[word[split]] + hashed[before[split]] * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(shards)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                word, before, second, doc, where = word[order], before[order], second[order], doc[order], where[order]
            train = part.column(2).to_numpy(zero_copy_only=False)
            flags = np.packbits(train).tobytes()
            bounds = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1], [True])))
            out = [(int(common.mix64(np.array([number], np.uint64))[0] % np.uint64(shards)), 0, _packed_head(part, train, sizes))]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                out.append((int(where[lo]), 1, _packed(hashed, word[lo:hi], before[lo:hi], second[lo:hi], doc[lo:hi], flags, len(sizes))))
            for lo in range(0, len(out), 64):
                some = out[lo : lo + 64]
                columns = [[x[0] for x in some], [number] * len(some), [x[1] for x in some], [x[2] for x in some]]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["shard", "batch", "kind", "data"])
            number += 1

    return run


def _packed_head(part: pa.RecordBatch, train: np.ndarray, sizes: np.ndarray) -> bytes:
    ids = part.column(0)
    null = ids.is_null().to_numpy(zero_copy_only=False)
    known = ids.fill_null(0).to_numpy().astype(np.int64)
    return b"".join(map(_planes, (known.view(np.uint64), null, train, sizes)))


def _packed(hashed, word, before, second, doc, flags: bytes, texts: int) -> bytes:
    """Occurrences, sorted by word, word before and word before that: each different word, pair
    and triple once, then the texts."""
    import zstandard

    new_word = np.concatenate(([True], word[1:] != word[:-1]))
    new_pair = new_word | np.concatenate(([True], before[1:] != before[:-1]))
    new_triple = new_pair | np.concatenate(([True], second[1:] != second[:-1]))
    pairs, triples = np.flatnonzero(new_pair), np.flatnonzero(new_triple)
    size = lambda new, of: np.diff(np.concatenate((np.flatnonzero(new), [of])))
    lower = lambda at, bits: hashed[at] >> (np.uint64(64) - bits)
    parts = [hashed[word[new_word]], size(new_word[pairs], len(pairs)), lower(before[pairs], BEFORE), size(new_pair[triples], len(triples)), lower(second[triples], SECOND), size(new_triple, len(word)), doc]
    head = np.array([texts, len(flags)], "<i8").tobytes() + flags
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(map(_planes, parts)))


def _unpacked(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """(which texts are learnt from, the parts)."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    texts, length = (int(x) for x in np.frombuffer(data, "<i8", 2))
    train = np.unpackbits(np.frombuffer(data, np.uint8, length, 16), count=texts).astype(bool)
    at, parts = 16 + length, []
    for k in range(7):
        part, at = _from_planes(data, at)
        parts.append(part if k in (0, 2, 4) else part.astype(np.int32))
    return train, parts


def _shard(hot, total: float, pair_weight: float, word_weight: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(b, 0, d) for b, k, d in zip(rows["batch"], rows["kind"], rows["data"], strict=True) if k == 0]
        given = [(b, *_unpacked(d)) for b, k, d in zip(rows["batch"], rows["kind"], rows["data"], strict=True) if k == 1]
        del rows
        if not given:
            return pd.DataFrame(out, columns=["batch", "kind", "data"])
        hashes = np.unique(np.concatenate([p[0] for _, _, p in given]))
        pairs, triples, learnt = [], [], []
        for _, train, p in given:
            pairs.append(np.repeat(np.searchsorted(hashes, p[0]).astype(np.uint64) << BEFORE, p[1]) | p[2])
            triples.append((np.repeat(np.arange(len(p[2]), dtype=np.int32), p[3]), p[4]))
            learnt.append(np.bincount(np.repeat(np.arange(len(p[5]), dtype=np.int32), p[5]), train[p[6]], len(p[5])).astype(np.int32))
            p[:5] = []  # sizes of triples and texts are needed again
        pair, pair_at = np.unique(np.concatenate(pairs), return_inverse=True)
        starts, pair_at = np.cumsum([0, *map(len, pairs)]), pair_at.astype(np.uint64)
        del pairs
        triple = np.concatenate([pair_at[lo + local] << SECOND | second for lo, (local, second) in zip(starts, triples, strict=False)])
        del triples, pair_at
        triple, triple_at = np.unique(triple, return_inverse=True)
        of_pair, of_triple = (pair >> BEFORE).astype(np.int64), (triple >> SECOND).astype(np.int64)
        c_triple = np.bincount(triple_at, np.concatenate(learnt), len(triple))
        del learnt
        c_pair = np.bincount(of_triple, c_triple, len(pair))
        c_word = np.bincount(of_pair, c_pair, len(hashes))
        known, counts = hot.value
        if (frequent := np.flatnonzero(_in(hashes, known))).size:  # other shards have them too
            c_word[frequent] = counts[np.searchsorted(known, hashes[frequent])]
        numerator, denominator = Trie(c_word, pair, c_pair, triple, c_triple, total, pair_weight, word_weight).look_up(pair, triple)
        word = of_pair[of_triple]
        value = numerator + np.where(hashes[word] == END, 0.0, denominator[of_triple])
        base, seen = np.log10(c_word + 0.5)[word], (c_word > 0)[word]
        del numerator, denominator, word, triple, pair, of_pair, of_triple
        lo = 0
        for batch, train, (sizes, doc) in given:
            each = triple_at[lo : lo + len(sizes)]
            lo += len(sizes)
            out.append((batch, 1, _packed_sums(doc, [np.repeat(x[each], sizes) for x in (seen, base, value)], len(train))))
        return pd.DataFrame(out, columns=["batch", "kind", "data"])

    return run


def _packed_sums(doc: np.ndarray, values: list[np.ndarray], texts: int) -> bytes:
    """For the texts in `doc` how many words are known, and the sums of both logarithms."""
    import zstandard

    there = np.zeros(texts, bool)
    there[doc] = True
    known, base, score = (np.bincount(doc, x, texts)[there] for x in values)
    parts = [_planes(np.packbits(there)), _planes(known.astype(np.int64)), base.astype("<f4").tobytes(), score.astype("<f4").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _scores(total: float, begin: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        head = next(d for k, d in zip(rows["kind"], rows["data"], strict=True) if k == 0)
        ids, at = _from_planes(head, 0)
        null, at = _from_planes(head, at)
        train, at = _from_planes(head, at)
        sizes, _ = _from_planes(head, at)
        known, base, score = (np.zeros(len(ids)) for _ in range(3))
        for kind, data in zip(rows["kind"], rows["data"], strict=True):
            if kind == 1:
                data = zstandard.ZstdDecompressor().decompress(data)
                bits, at = _from_planes(data, 0)
                seen, at = _from_planes(data, at)
                doc = np.flatnonzero(np.unpackbits(bits.astype(np.uint8), count=len(ids)))
                known[doc] += seen
                base[doc] += np.frombuffer(data, "<f4", len(doc), at)
                score[doc] += np.frombuffer(data, "<f4", len(doc), at + 4 * len(doc))
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if n else i for i, n in zip(ids.view(np.int64).tolist(), null.tolist(), strict=True)], "Int64"),
                "trained": train.astype(bool),
                "n_tokens": sizes.astype(np.int64),
                "n_known": known.astype(np.int64),
                "base_score": base - sizes * np.log10(total),
                "score": score + begin,
            }
        )

    return run


def score(docs: DataFrame, train, pair_weight: float = PAIR_WEIGHT, word_weight: float = WORD_WEIGHT) -> DataFrame:
    """One row per document: doc_id, trained, n_tokens, n_known, train_tokens, base_score, score.

    `train` is the condition, a Column over `docs`, for a text to be learnt from. A token is a
    word, A-Z lower-cased, or the end of a text. A null or empty text is its end alone. Rows
    that repeat a doc_id, or have none, are learnt from and scored each. Without training texts
    every count is 0. Words are told apart by 64 bits of hash. An empty table gives an empty one.
    """
    context = docs.sparkSession.sparkContext
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.coalesce(train, F.lit(False)).alias("train"),
    )
    counts = common.stored(rows.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    facts = counts.where("word is not null").agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    every = counts.where("word is null").agg(F.sum("n")).first()[0] or 0
    tokens = facts["n"] or 0
    total = tokens + 0.5 * (facts["v"] + 1)
    shards = max(8, -(-every // SHARD_WORDS))
    frequent = counts.where(F.col("word").isNotNull() & (F.col("n") > max(SHARD_WORDS // 4, tokens // HOT))).collect()
    table = sorted((x["word"] & ((1 << 64) - 1), x["n"]) for x in frequent)  # HOT at most, since all together have `tokens`
    hot = context.broadcast((np.array([x[0] for x in table], np.uint64), np.array([x[1] for x in table], float)))
    learnt = int(rows.where("train").count())
    begin = -np.log10(learnt * (1 + pair_weight) + word_weight)
    routed = rows.mapInArrow(_routed(hot, shards), "shard long, batch long, kind int, data binary")
    found = routed.groupBy("shard").applyInPandas(_shard(hot, total, pair_weight, word_weight), "batch long, kind int, data binary")
    scored = found.groupBy("batch").applyInPandas(
        _scores(total, begin), "doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.withColumn("train_tokens", F.lit(tokens).cast("long"))
