"""The corpus operators against brute force, round trips and held-out accuracy, on small tables
with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import random
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from capture_tables.llm import bpe, common, components, exact_dedup, language_id, line_dedup, ngram_lm, packing, simhash, suffix_dedup, topk, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component_id long, kept boolean"
random.seed(5)
VOCABULARY = ["".join(random.choice("abcdeilnorst") for _ in range(random.randint(2, 8))) for _ in range(300)]


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


def texts():
    passage = words(60, 1)
    out = [None, "", " \t\n", "one", "Same text here now", "same  text here now", "Same text here now"]
    out += [words(80, 10 + k) for k in range(6)]
    out += [f"{words(30, 30 + k)} {passage} {words(20, 60 + k)}" for k in range(4)]
    out += ["\n".join(words(9, 100 + j) for j in range(5)), "\n".join(words(9, 102 + j) for j in range(5)), words(9, 100) + " extra\n" + words(12, 999)]
    out += [words(12_000, 7), "x" * 30_000, "É😀 ß " * 40]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", "de", None][k % 3], "src0", 0, "clash", -1, None) for k, t in enumerate(texts())]
    rows.append(rows[8])  # a repeated row
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def pairs():
    return list(enumerate(t or "" for t in texts()))


def test_exact_groups(docs, empty):
    found = {r.doc_id: r for r in exact_dedup.groups(docs).collect()}
    strip = str.maketrans("", "", " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for k, t in [*pairs(), pairs()[8]]:
        groups[t.translate(strip)].append((-len(t), k))
    for k, t in pairs():
        members = groups[t.translate(strip)]
        assert found[k].keep_id == min(members)[1] and found[k].group_size == len(members)
    large = [(None, "twice"), ((1 << 63) - 1, "twi ce"), (9, "twice "), (None, "three"), (None, "th ree")]
    found = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.groups(docs.sparkSession.createDataFrame(large, "doc_id long, text string")).collect()}
    assert found == {(None, 9, 3, False), ((1 << 63) - 1, 9, 3, False), (9, 9, 3, True), (None, None, 2, True)}
    assert exact_dedup.groups(empty).count() == 0
    assert set(exact_dedup.deduplicate(docs).columns) == set(docs.columns)


def test_colliding_chunk_hashes_are_told_apart(spark, docs, monkeypatch):
    """With a hash that is the same for all chunks, the chunks themselves decide."""
    digest, one = exact_dedup.recipes, F.lit(1).cast("long")
    monkeypatch.setattr(exact_dedup, "recipes", lambda d: digest(d).withColumn("recipe", F.transform("recipe", lambda h: one)))
    monkeypatch.setattr(exact_dedup, "_collisions", lambda d, keys: spark.createDataFrame([(1, "x"), (1, "y")], "hash long, chunk string"))
    some = docs.select("doc_id", "text").union(spark.createDataFrame([(None, "Same text here now"), (50, "Same texthere\tnow")], "doc_id long, text string"))
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.groups(some).collect()}
    assert found[4] == found[6] == found[50] == found[None] == (4, 4) and found[5] == (5, 1)
    assert found[0] == found[1] == found[2] == (2, 3) and found[7] == (7, 1) and found[8] == (8, 2)


def test_cuts_fall_into_step_behind_an_insertion(spark):
    base = words(3000, 21).replace("a ", "ar, ")
    df = spark.createDataFrame([(1, base), (2, "inserted words " + base)], "doc_id long, text string")
    one, two = (set(r.recipe) for r in exact_dedup.recipes(df).orderBy("doc_id").collect())
    assert len(one) > 10 and len(one & two) > 0.7 * len(one)


def test_simhash_components(docs, empty):
    prints = {k: simhash.fingerprint(t) for k, t in pairs()}
    for k, t in pairs():
        w = t.encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        assert prints[k] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {k: k for k in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    found = simhash.components(docs, block=4).collect()
    assert all(find(r.doc_id) == r.component_id for r in found) and len(found) == docs.count()
    assert simhash.components(empty).count() == 0


def test_tiles_lose_no_link(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(60)]
    values = sorted({b ^ sum(1 << k for k in r.sample(range(64), n)) for b in base for n in (0, 1, 1, 2, 3)})
    signed = [(v - (1 << 64) if v >> 63 else v,) for v in values]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), block=16)
    found = {row.node: row.root for row in components.connected_components(links).collect()}
    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = signed[i][0], signed[values.index(b)][0]
                assert found[x] == found[y]


def cut_by_brute_force(rows, least=50):
    """{(doc_id, text): for each word whether it goes}, of rows in order of (doc_id, print)."""
    first, wanted = {}, {}
    for k, t, _ in rows:
        w = t.encode().lower().split()
        hit = [False] * len(w)
        for s in range(len(w) - least + 1):
            if first.setdefault(tuple(w[s : s + least]), (k, t, s)) != (k, t, s):
                hit[s : s + least] = [True] * least
        wanted[k, t] = hit
    return wanted


def test_repeated_passages(spark, docs, empty, monkeypatch):
    passage, licence = words(60, 1), words(20, 2)
    rows = [(3000 + k, f"{words(40, 400 + k)} {licence} {words(40, 500 + k)}") for k in range(12)]  # a seed in many surroundings
    rows += [(3001, f"another {passage.upper()} end"), ((1 << 63) - 5, passage), (-9, words(80, 10)), (None, passage), (3020, (words(55, 5) + " ") * 3)]
    rows += [(3021, f"{rows[3][1]}"), (3022, f"{words(10, 9)} " + " ".join(rows[5][1].split()[20:90]))]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([*rows, rows[2]], "doc_id long, text string")).repartition(3)
    prints = both.where("doc_id is not null").selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as print").distinct()
    ordered = sorted((tuple(x) for x in prints.collect()), key=lambda x: (x[0], x[2]))
    wanted = cut_by_brute_force(ordered)
    assert sum(map(sum, wanted.values())) >= 5 * 60
    by_print = {(k, p): t for k, t, p in ordered}
    for hot in (False, True):
        if hot:
            monkeypatch.setattr(suffix_dedup, "HOT", 3)
            monkeypatch.setattr(suffix_dedup, "HELD", 20)
        found = suffix_dedup.repeats(both).collect()
        assert len(found) == len(ordered)
        for row in found:
            hit = wanted[row.doc_id, by_print[row.doc_id, row.print]]
            got = [False] * len(hit)
            for span in row.spans:
                got[span.first : span.last] = [True] * (span.last - span.first)
            assert got == hit and (row.n_removed, row.n_words) == (sum(hit), len(hit))
    cut = Counter((r.doc_id, r.text) for r in suffix_dedup.remove_repeats(both).collect())
    for (k, t), hit in wanted.items():
        if not any(hit):
            assert sum(n for (d, x), n in cut.items() if (d, x or "") == (k, t)) >= 1
        elif all(hit):
            assert k not in {d for d, _ in cut}
        else:
            assert any(d == k and x.split() == [w for w, h in zip(t.split(), hit) if not h] for d, x in cut)
    assert (None, passage) in cut
    assert suffix_dedup.repeats(empty).count() == 0 == suffix_dedup.remove_repeats(empty).count()
    assert suffix_dedup.remove_repeats(docs).columns == docs.columns


def removed_by_brute_force(rows):
    """{(doc_id, text): numbers of removed lines}; rows of one doc_id come by their text's hash."""
    seen, wanted = [], {}
    for k, t, _ in rows:
        wanted[k, t] = []
        for n, line in enumerate(t.encode().lower().split(b"\n")):
            s = set(line.split())
            if s:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    wanted[k, t].append(n)
                seen.append(s)
    return wanted


def line_texts():
    short = ["Les.\nun deux", "les.\n\n深い森の中で", "a b c d\nDEUX un\n深い森の中で", "e d c b a\nun deux trois", "a b c d e f\nun deux\n   "]
    return short + ["k l m n o", "n m l k", "n m l k", "one", "x y z", "x y w"]


def with_lines(spark, docs):
    """Documents with short lines, near copies, repeated rows, and ids that are large, negative,
    null or shared by different texts."""
    rows = [(1000 + k, t) for k, t in enumerate(line_texts())]
    r = random.Random(11)
    base = words(30, 77).split()
    for k in range(60):  # a group of near copies, some of them similar to few others only
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(30)] = r.choice(VOCABULARY)
        rows.append((2000 + k, " ".join(w)))
    rows += [(1000, "another text\nLes."), ((1 << 63) - 7, "far away\n" + words(9, 100)), (-5, "below zero\nk l m n o"), (None, "un deux")]
    more = spark.createDataFrame([*rows, rows[2]], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(more)
    prints = both.where("doc_id is not null").selectExpr("doc_id", "coalesce(text, '') as text", "xxhash64(coalesce(text, '')) as print").distinct()
    return both, sorted((tuple(x) for x in prints.collect()), key=lambda x: (x[0], x[2]))


def test_repeated_lines(spark, tmp_path, docs, empty, monkeypatch):
    """Against brute force, in the operator, op4 and the pipeline, with small groups dealt."""
    import corpus_pipeline
    from capture_tables.llm import queries

    both, rows = with_lines(spark, docs)
    path = str(tmp_path)
    both.repartition(3).write.parquet(f"{path}/documents.parquet")
    wanted = removed_by_brute_force(rows)
    removed = lambda found: sorted((x.doc_id, x.n_lines, x.removed) for x in found.collect())
    expected = sorted((k, t.count("\n") + 1, gone) for (k, t), gone in wanted.items())
    assert sum(len(x[2]) for x in expected) >= 40
    assert removed(queries.op4_line_dedup(spark, path)) == expected
    kept = {(x.doc_id, x.text) for x in corpus_pipeline.drop_repeated_lines(spark, both, path).collect()}
    assert (1001, "\n深い森の中で") in kept and (1002, "a b c d") in kept and (None, "un deux") in kept
    assert not {k for k, _ in kept} & {1006, 1007}
    assert (1000, "another text") in kept or (1000, "un deux") in kept
    monkeypatch.setattr(line_dedup, "TRIES", 1)
    monkeypatch.setattr(line_dedup, "BLOCK", 4)
    monkeypatch.setattr(line_dedup, "PAIRS", 50)
    monkeypatch.setattr(line_dedup, "SIEVE_MOST", 1)
    assert removed(line_dedup.report(both)) == expected
    assert line_dedup.report(empty).count() == 0 == line_dedup.remove_lines(empty).count()
    assert line_dedup.remove_lines(docs).columns == docs.columns


def best_of(whole, asks, k):
    """Sorted (query_id, [(vec_id, score), ...]) by brute force; whole: (vec_id, vector) rows."""
    out = []
    for i, (q, v) in enumerate(whole):
        if asks(q):
            others = [(-sum(map(int.__mul__, v, w)), x) for j, (x, w) in enumerate(whole) if j != i and len(w) == len(v)]
            out.append((q, [(x, -s) for s, x in sorted(others)[:k]]))
    return sorted(out)


def test_top_k(spark):
    r = np.random.default_rng(3)
    data = [(k, [float(x) for x in r.normal(size=8) * (1 + 20 * (k % 37 == 0))]) for k in range(400)]
    data += [(500, None), (501, [1.0, None] * 4), (502, [float("nan")] * 8), (503, [0.0] * 8), (504, data[7][1]), (505, [1.0]), (None, [1.0] * 8)]
    data += [(20, data[3][1]), (20, data[20][1]), (40, data[40][1]), (510, [4e7] * 3), (511, [-4e7] * 3), (512, [1.0] * 3), (520, [2.0] * 3)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit("clash")).withColumn("mark", F.lit(None))
    vectors = topk.whole_numbers(table).cache()
    whole = [(row.vec_id, row.v) for row in vectors.collect()]
    assert {k for k, _ in whole} == {*range(400), 503, 504, 505, 510, 511, 512, 520}
    asks = lambda k: k % 20 == 0 or k == 503 or k == 510
    for block in (64, 4096):
        found = defaultdict(list)
        for row in topk.top_k(vectors, F.expr("vec_id % 20 = 0 or vec_id in (503, 510)"), 5, block).collect():
            found[row.query_id].append((row.rank, row.vec_id, row.score))
        wanted = defaultdict(list)
        for q, best in best_of(whole, asks, 5):
            wanted[q] += [(n, x, max(min(s, (1 << 63) - 1), -(1 << 63))) for n, (x, s) in enumerate(best, 1)]
        assert {q: sorted(x) for q, x in found.items()} == {q: sorted(x) for q, x in wanted.items()}
    assert topk.top_k(vectors.where("false"), F.lit(True), 5).count() == 0 == topk.top_k(vectors, F.lit(None).cast("boolean"), 5).count()


def test_walks_end_early_where_they_can():
    r = np.random.default_rng(4)
    rows = r.integers(-50, 50, (2000, 3))
    rows[5], rows[77] = (900, 900, 900), (890, 900, 900)
    lists = topk.SortedLists(np.arange(2000), np.arange(2000), rows)
    queries = np.array([[3, 2, 1], [-1, 0, 0], [0, 0, 0]])
    for least in (None, 4000):
        found = lists.top(queries, np.array([5, -1, 7]), 2, [least] * 3)
        for q, own, (at, scores) in zip(queries, (5, -1, 7), found, strict=True):
            best = sorted((-int(x @ q), k) for k, x in enumerate(rows) if k != own)[:2]
            assert least is not None and -best[0][0] < least or list(zip((-scores).tolist(), at.tolist(), strict=True))[:1] == best[:1]


def test_bpe_equals_the_library_and_streams():
    path = packing.vocabulary_path(bpe.VOCABULARY)
    library, model = Tokenizer.from_file(path), bpe.WordBpe(path)
    r = random.Random(4)
    more = ["".join(r.choice("abc étéŸßΣİ '\t\n12<|endoftext|>😀日\x1c") for _ in range(r.randint(0, 60))) for _ in range(400)]
    for t in [*(t for _, t in pairs()), *more, "<|endoftext|>x", "it's  o'clock"]:
        ids = library.encode(t, add_special_tokens=False).ids
        got, decoded = model.translate(t)
        assert np.frombuffer(got, "<u4").tolist() == ids
        assert decoded == library.decode(ids, skip_special_tokens=False)
    tr = model.transducer
    assert not {t for t in tr.tokens if tr.encode(t.removesuffix("\n")) != [tr.ids[x] for x in tr.merged(tr.symbols_of(t.removesuffix("\n") + "\n"))]}
    for _ in range(300):
        w = "".join(r.choice("thenaiors") for _ in range(r.randint(1, 200)))
        plain = [tr.ids[x] for x in tr.merged(tr.symbols_of(w + "\n"))]
        assert list(tr.stream(w)) == plain == tr.encode(w)
    back = "".join(model.decoder.text(np.frombuffer(model.translate("été 日本 😀")[0], "<u4").tolist()))
    assert back == "été 日本 😀 "


def test_bpe_over_a_table(docs, empty):
    """op7's digests by the library, with nulls, empty and long texts and a repeated row."""
    library = Tokenizer.from_file(packing.vocabulary_path(bpe.VOCABULARY))
    rows = bpe.encode(docs, with_texts=True).collect()
    assert sorted(r.doc_id for r in rows) == sorted([*range(len(texts())), 8])
    for r in rows:
        ids = library.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, decoded, len(ids))
        assert r.ids_sha256 == sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == sha256(decoded.encode()).hexdigest()
    assert bpe.encode(empty).count() == 0


def test_packing_places_every_id_once(docs, empty):
    library = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    rows = packing.pack(docs.where("doc_id <> 8")).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append(row)
    for k, t in pairs():
        if k == 8:
            continue
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for row in sorted(by_doc[k], key=lambda x: x.start):
            assert row.start == at and row.ids_crc32 == zlib.crc32(ids[at : at + row.length].tobytes())
            at += row.length
        assert at == len(ids) == by_doc[k][0].doc_tokens
    for pieces in by_sequence.values():
        at = 0
        for row in sorted(pieces, key=lambda x: x.offset):
            assert row.offset == at
            at += row.length
        assert at <= packing.WINDOW
    assert packing.pack(empty).count() == 0


def test_packing_pads_one_window_at_most():
    packer, r = packing.Packer(64), random.Random(6)
    sizes = [r.randint(1, 200) for _ in range(500)]
    for k, n in enumerate(sizes):
        packer.add(k, n)
    packer.finish()
    fill = Counter()
    for piece, window, _ in packer.placed:
        fill[window] += piece[2]
    assert sum(fill.values()) == sum(sizes) and sum(v < 64 for v in fill.values()) <= 1


def test_language_model_scores(spark, docs, empty, monkeypatch):
    """Against brute force, with frequent words dealt by pairs."""
    both = docs.union(spark.createDataFrame([(None, "Same words words", *[None] * 6), (-4, words(300, 3), *[None] * 6)], SCHEMA))
    rows = [(r.doc_id, r.text or "", bool(r.doc_id is not None and np.fmod(r.doc_id, 5) != 1)) for r in both.collect()]
    tokens = [["<s>", "<s>", *t.encode().lower().split(), b""] for _, t, _ in rows]
    learnt = [w for w, (_, _, train) in zip(tokens, rows) if train]
    count = Counter(x for w in learnt for x in w[2:])
    two = Counter(x for w in learnt for x in zip(w[1:], w[2:]))
    three = Counter(x for w in learnt for x in zip(w, w[1:], w[2:]))
    n, v = sum(count.values()), len(count)
    p = lambda w: (count[w] + 0.5) / (n + 0.5 * (v + 1))
    context = Counter(x for w in learnt for x in w[1:-1])
    pairs = Counter(x for w in learnt for x in zip(w[:-2], w[1:-1]))
    model = lambda a, b, c: (three[a, b, c] + 0.1 * two[b, c] + 4 * p(c)) / (pairs[a, b] + 0.1 * context[b] + 4)
    wanted = []
    for (k, _, _), w in zip(rows, tokens):
        wanted.append((k or -1, len(w) - 2, sum(x in count for x in w[2:]), n, sum(np.log10(p(x)) for x in w[2:]), sum(np.log10(model(*x)) for x in zip(w, w[1:], w[2:]))))
    wanted.sort()
    for hot in (False, True):
        if hot:
            monkeypatch.setattr(ngram_lm, "SHARD_WORDS", 400)
            monkeypatch.setattr(ngram_lm, "BATCH", 3000)
        found = ngram_lm.score(both, F.col("doc_id") % 5 != 1, 0.1, 4.0).collect()
        got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found)
        assert [x[:4] for x in got] == [x[:4] for x in wanted]
        for x, y in zip(got, wanted):
            assert x[4] == pytest.approx(y[4], rel=1e-6) and abs(x[5] - y[5]) <= 0.001 * y[1]  # quantised
    assert ngram_lm.score(empty, F.lit(True)).count() == 0
    assert ngram_lm.score(docs, F.lit(False)).first().train_tokens == 0


def test_elias_fano_holds_its_values():
    r = np.random.default_rng(1)
    values = np.sort(r.integers(0, 1 << 40, 5000).astype(np.uint64))
    packed = ngram_lm.EliasFano(values, lambda a: a)
    assert (packed[np.arange(5000)] == values).all()
    target = r.integers(0, 1 << 40, 500).astype(np.uint64)
    at = packed.find(target, np.zeros(500, np.int64), np.full(500, 5000))
    assert (at == np.searchsorted(values, target)).all()


def test_language_is_found_on_held_out_texts(spark):
    r = random.Random(8)
    sound = {"aa": "abcdeiou", "bb": "klmnoprst", "cc": "vwxyzäöü"}
    rows = [(k, " ".join("".join(r.choice(sound[lang]) for _ in range(6)) for _ in range(20)), lang) for k in range(240) for lang in [list(sound)[k % 3]]]
    docs = spark.createDataFrame([*rows, (900, None, "aa"), (901, "12 34", None)], "doc_id long, text string, lang string")
    model = language_id.fit(docs.where("doc_id % 4 <> 2"), per_language=40)
    long, clash = (903, "kompro " * 40_000, "bb"), docs.where("doc_id = 5").withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit("y"))
    more = clash.unionByName(docs.where("doc_id = 5"), True).unionByName(spark.createDataFrame([long], docs.schema), True)
    assert sorted((x.doc_id, x.lang_pred) for x in language_id.predict(more, model).collect()) == [(5, "cc"), (5, "cc"), (903, "bb")]
    assert language_id.predict(docs.where("false"), model).count() == 0
    found = {x.doc_id: x for x in language_id.predict(docs, model).collect()}
    assert all(found[k].lang_pred == lang for k, _, lang in rows if k % 4 == 2)
    assert found[900].lang_pred == found[901].lang_pred == "und"
    assert language_id.predict(docs, language_id.fit(docs.where("false"))).first().lang_pred == "und"


def test_every_language_is_learnt_in_bounded_weights(spark, monkeypatch):
    monkeypatch.setattr(language_id, "WEIGHTS", 1 << 14)
    r = random.Random(9)
    letters = [chr(0x4E00 + 7 * k) for k in range(400)]
    rows = [(k * 100 + n, "".join(r.choice(letters[5 * k : 5 * k + 5]) for _ in range(40)), f"l{k:02d}") for k in range(40) for n in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model["languages"]) == 40 and len(model["idf"]) == language_id.places_for(40) == 256
    found = {x.doc_id: x.lang_pred for x in language_id.predict(docs, model).collect()}
    assert np.mean([found[k] == lang for k, _, lang in rows]) > 0.8


def test_toxic_documents_go_and_clean_ones_stay(spark):
    bad = ["vile", "nasty", "rotten", "filthy"]
    rows, labels = [], []
    for k in range(400):
        r = random.Random(k)
        toxic = k % 5 == 0
        rows.append((k, words(40, 5000 + k) + (" " + " ".join(r.sample(bad, 2)) if toxic else ""), "x"))
        if k % 2 == 0:
            labels.append((k, int(toxic)))
    docs = spark.createDataFrame([*rows, (None, "vile", "x"), (999, None, "x")], "doc_id long, text string, rejected string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    kept = toxicity.remove_toxic(docs, marks)
    assert {r.doc_id for r in kept.collect()} == {k for k in range(400) if k % 5} | {None, 999}
    assert kept.columns == docs.columns
    assert toxicity.remove_toxic(docs, marks.where("false")).count() == 402


def test_few_labels_make_a_model(spark):
    """Words of five toxic labels reject other documents, as do the words planted in sf0.001."""
    bad = ["vile", "nasty", "rotten", "filthy"]
    few = [(k, words(40, 7000 + k) + (" " + " ".join(bad) if k % 10 == 0 else ""), int(k % 10 == 0)) for k in range(100)]
    docs = spark.createDataFrame(few, "doc_id long, text string, toxic int")
    kept = toxicity.remove_toxic(docs, docs.where("doc_id < 50").select("doc_id", "toxic"))
    assert {r.doc_id for r in kept.collect()} == {k for k in range(100) if k % 10}

    import corpus_pipeline

    planted = {"trash", "idiot", "pathetic", "disgusting", "worthless", "stupid", "clown", "loser", "scum", "moron"}
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet") for name in ("documents", "labels"))
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.001").collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    texts_of = {r.doc_id: r.text or "" for r in docs.collect()}
    held = {k for k, t in texts_of.items() if len(set(t.lower().translate(str.maketrans(dict.fromkeys(".,;:!?", " "))).split()) & planted) >= 2}
    assert len(held) >= 5 and not held & kept, (held & kept, len(held))
    assert not toxic & kept and clean <= kept


def test_grades_come_from_rows_that_a_model_has_not_seen():
    """Of toxic rows those with more of what marks toxic rows elsewhere get higher grades."""
    r = np.random.default_rng(3)
    rows = [([0] if k % 2 else []) + ([1, 2, 3] if k % 3 == 0 else []) if k < 120 else [4 + int(r.integers(6))] for k in range(600)]
    toxic = np.array([int(k < 120) for k in range(600)])
    row, column = np.repeat(np.arange(600), list(map(len, rows))), np.array([c for x in rows for c in x])
    grade = toxicity.graded(row, column, toxic, 10)
    assert (grade[120:] == 0).all() and set(grade[:120]) == {1, 2, 3}
    assert np.mean([grade[k] for k in range(120) if k % 3 == 0]) > np.mean([grade[k] for k in range(120) if k % 3]) + 0.5


def test_severity_is_defined_for_all_texts(spark, docs, empty):
    marks = spark.createDataFrame([(3, 1), (9, 0), (9, 1), (10, 0)], "doc_id long, toxic int")
    found = toxicity.grade(docs, toxicity.fit(docs, marks)).collect()
    assert len(found) == docs.count() and all(0 <= x.severity <= 3 for x in found)
    assert toxicity.grade(empty, toxicity.fit(empty, marks)).count() == 0


def test_severity_thresholds_stay_in_order():
    x = np.array([[0.0], [0.0], [1.0], [1.0]] * 20)
    w, t = toxicity.fit_ordinal(x, np.array([0, 0, 1, 2] * 20), 3)
    assert w[0] > 0 and (np.diff(t) > 0).all()


def test_pipeline_runs_its_stages(spark, tmp_path):
    import corpus_pipeline
    from capture_tables.llm import common

    sf_dir = "/root/testdata/sf0.001"
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns and docs.count() > 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def corpus_rows():
    """(doc_id, text): clean texts, toxic ones, exact and near copies, repeated lines and passages,
    null and empty texts, a repeated row and two texts of one id."""
    passage, base = words(60, 301), words(120, 302).split()
    rows = [(k, words(50, 6000 + k) + "\n" + words(12, 7000 + k)) for k in range(120)]
    rows += [(200 + k, words(30, 8000 + k) + " vile nasty rotten filthy") for k in range(40)]
    rows += [(300 + k, f"{words(60, 310 + k)} {passage} {words(30, 320 + k)}") for k in range(4)]
    rows += [(400 + k, " ".join(base[:k] + ["changed"] + base[k + 1 :])) for k in (3, 60)]
    rows += [(420, words(50, 6005) + "\n" + words(9, 1)), (421, words(12, 7009)), (430, None), (431, ""), (432, " \n"), (None, words(20, 55)), (None, None)]
    rows += [(440, rows[0][1] + "\n" + words(8, 99)), (440, words(70, 98)), rows[7], (450, words(30, 8001) + " vile nasty rotten filthy")]
    return rows


def by_hand(rows, toxic):
    """What the first four stages keep of the rows, by plain Python: [(doc_id, text)]."""
    import re

    blank = lambda t: not t.encode().split()
    kept = [(k, t) for k, t in rows if k not in toxic]
    prints = {(k, t): xxhash.xxh64_intdigest((t or "").encode(), 42) for k, t in kept}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    in_order = lambda kept: [(k, t, 0) for k, t in sorted({(k, t or "") for k, t in kept if k is not None}, key=lambda x: (x[0], signed(xxhash.xxh64_intdigest(x[1].encode(), 42))))]
    assert prints
    gone, out = removed_by_brute_force(in_order(kept)), []
    for k, t in kept:
        numbers = gone.get((k, t or ""), [])
        if numbers:
            t = "\n".join(line for n, line in enumerate(t.split("\n")) if n not in numbers)
            if blank(t):
                continue
        out.append((k, t))
    prints = [simhash.fingerprint(t or "") for _, t in out]
    root = list(range(len(out)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    known = [i for i, (k, _) in enumerate(out) if k is not None]
    for i in known:
        for j in known:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(j)] = find(i)
    least = {}
    for i in known:
        least[find(i)] = min(least.get(find(i), 1 << 62), out[i][0])
    dropped = {out[i][0] for i in known if least[find(i)] != out[i][0]}
    out = [(k, t) for k, t in out if k not in dropped]
    cut, kept = cut_by_brute_force(in_order(out)), []
    for k, t in out:
        hit = cut.get((k, t or ""), [])
        if k is not None and any(hit):
            data, parts, at = t.encode(), [], 0
            places = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
            n = 0
            while n < len(hit):
                if hit[n]:
                    parts.append(data[at : places[n][0]])
                    while n < len(hit) and hit[n]:
                        n += 1
                    at = places[n - 1][1]
                else:
                    n += 1
            t = b"".join([*parts, data[at:]]).decode()
            if blank(t):
                continue
        kept.append((k, t))
    return kept


def test_pipeline_equals_plain_stages(spark, tmp_path):
    """run() over a small corpus against plain Python: which ids go into which windows is free,
    but each kept document's ids stand once, in order, in windows of 2048 without gaps."""
    import corpus_pipeline

    rows = corpus_rows()
    labels = [(k, int(200 <= k < 240)) for k, _ in rows if k is not None and k % 2 == 0 and k < 240]
    path = str(tmp_path)
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows], columns)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(k, 1, x) for k, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    kept = by_hand(rows, {k for k, _ in rows if k is not None and 200 <= k < 240} | {450})
    assert {401, 403, 420, 421, 431} & {k for k, _ in kept} != {401, 403, 420, 421, 431} and 120 < len(kept) < len(rows) - 41
    library = Tokenizer.from_file(packing.vocabulary_path(packing.VOCABULARY))
    wanted = Counter()
    for k, t in kept:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        wanted[k, len(ids), zlib.crc32(ids.tobytes()) if len(ids) <= 2048 else None] += 1
    found = corpus_pipeline.run(spark, path).collect()
    whole = Counter((r.doc_id, r.doc_tokens, r.ids_crc32) for r in found if r.length == r.doc_tokens)
    assert not whole - wanted
    assert sum(r.length for r in found) == sum(n * c for (_, n, _), c in wanted.items())
    assert Counter(r.doc_id for r in found if r.start == 0) == Counter(k for k, _ in kept)
    windows = defaultdict(list)
    for r in found:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    # without documents or labels
    none = str(tmp_path / "none")
    docs.where("false").write.parquet(f"{none}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{none}/labels.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0


CONTRACT = {
    "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
    "op2_exact_dedup": {"doc_id", "keep_id", "group_size", "kept", "text_sha256"},
    "op3_suffix_dedup": {"doc_id", "n_words", "n_removed", "spans"},
    "op6_lm_score": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op7_bpe": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op8_simhash": {"doc_id", "fingerprint", "component_id"},
    "op9_toxicity": {"doc_id", "severity", "p_toxic", "grade", "rejected"},
    "op10_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_registered_queries_give_a_row_for_each_document(spark, name):
    from capture_tables.llm import queries

    sf_dir = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries.QUERIES[name](spark, sf_dir).collect()
    assert set(found[0].asDict()) == CONTRACT[name]
    assert {r.doc_id for r in found} == set(docs) and (len(found) == len(docs) or name == "op10_packing")
    if name == "op1_language_id":
        held = [r for r in found if r.held_out and docs[r.doc_id].lang is not None and any(map(str.isalpha, docs[r.doc_id].text or ""))]
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
        assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.9
    if name == "op8_simhash":
        assert all(int(r.fingerprint, 16) == simhash.fingerprint(docs[r.doc_id].text or "") for r in found)


def structured(n):
    """Two words of n letters that polynomial hashes modulo a power of two take for one."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(n))
    return one, one.translate(str.maketrans("ab", "ba"))


def test_structured_words_are_told_apart(spark):
    hashes = [h for n in (8, 1024, 4096, 65536) for h in common.Scan(pa.array([" ".join(structured(n))])).hashes.tolist()]
    assert len(set(hashes)) == len(hashes)
    same = common.Scan(pa.array(["AbC ABCDEFGHIJ\nabc abcdefghij", "abcdefgh abcdefghi " + "é" * 9]), (4, 7))
    assert [same.hashes[k] == same.hashes[k + 2] for k in (0, 1)] == [True, True] and len(set(same.hashes.tolist())) == 5
    assert [(at.tolist(), len(set(h.tolist()))) for at, h in same.begun] == [([1, 3, 4, 5, 6], 2), ([1, 3, 4, 5, 6], 2)]
    one, other = structured(1024)
    lines = spark.createDataFrame([(1, one), (2, other)], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.report(lines).collect()] == [0, 0]
    passage = lambda w: " ".join([w] * 50)
    assert [r.n_removed for r in suffix_dedup.repeats(spark.createDataFrame([(1, passage(one)), (2, passage(other))], lines.schema)).collect()] == [0, 0]
    known = ngram_lm.score(spark.createDataFrame([(1, one), (2, other)], lines.schema), F.col("doc_id") == 1)
    assert {r.doc_id: (r.n_known, r.train_tokens) for r in known.collect()} == {1: (2, 2), 2: (1, 2)}


def test_lines_beyond_what_24_bits_number(monkeypatch):
    r = random.Random(1)
    text = pa.array(["\n".join(" ".join(r.choices("abcdefg", k=r.randint(0, 9))) for _ in range(300)) for _ in range(3)])
    few = line_dedup.Lines(text)
    monkeypatch.setattr(line_dedup, "LINES", 10)
    many = line_dedup.Lines(text)
    assert all((getattr(few, n) == getattr(many, n)).all() for n in ("row", "number", "size", "words", "heads"))


def test_sql_and_queries_agree(spark):
    import duckdb
    from capture_tables.llm import queries

    con, sf_dir = duckdb.connect(), "/root/testdata/sf0.001"
    for name in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        wanted = con.sql(sql)
        found = queries.QUERIES[name](spark, sf_dir).select(*wanted.columns)
        assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())
