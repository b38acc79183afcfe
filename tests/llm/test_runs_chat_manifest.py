"""Periodic runs, chat formatting and Merkle manifests against brute force and round trips, on small
tables with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import json
import random
import zlib
from collections import defaultdict
from fractions import Fraction
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from capture_tables.llm import chat, merkle, periods

# ---- periodic runs


def plain_runs(w):
    """Every maximal stretch with a period, its smallest, of three periods and 24 words at least."""
    n, out = len(w), {}
    for q in range(1, n // 3 + 1):
        t = q
        while t < n:
            if w[t] != w[t - q]:
                t += 1
                continue
            lo = t
            while t < n and w[t] == w[t - q]:
                t += 1
            if t - lo + q >= max(24, 3 * q):
                out.setdefault((lo - q, t - lo + q), q)
    return sorted((a, length, q) for (a, length), q in out.items())


def repetitive(r):
    letters, w = "abcdefgh"[: r.choice([1, 2, 2, 3, 8])], []
    for _ in range(r.randint(1, 4)):
        base = [r.choice(letters) for _ in range(r.randint(1, 60))]
        w += [r.choice(letters) for _ in range(r.randint(0, 40))] + (base * 12)[: int(len(base) * r.uniform(1, 9))]
    return w


def test_runs_equal_brute_force_however_words_arrive():
    r = random.Random(3)
    texts = [repetitive(r) for _ in range(300)] + [["a"] * n for n in (23, 24, 25, 300)] + [list("ab") * 50, [], ["x"]]
    wanted = [plain_runs(w) for w in texts]
    assert sum(map(len, wanted)) > 300
    assert periods.runs_of([[x.encode() for x in w] for w in texts]) == wanted
    for w, runs in list(zip(texts, wanted, strict=True))[::6]:
        numbers = np.array([ord(c) for c in w], np.int64)
        for step in (1, 7, 33):
            catchers = periods.Catchers()
            for k in range(0, len(w), step):
                catchers.append(numbers[k : k + step])
            assert catchers.runs() == runs


def test_runs_of_structured_and_long_sequences():
    fibonacci, before = [0, 1], [0]
    while len(fibonacci) < 900:
        before, fibonacci = fibonacci, fibonacci + before
    assert periods.runs_of([[str(c).encode() for c in fibonacci]]) == [plain_runs(fibonacci)]
    thue_morse = [k.bit_count() % 2 for k in range(4096)]  # no cubes
    assert periods.runs_of([[str(c).encode() for c in thue_morse]]) == [[]]
    part = np.random.default_rng(1).integers(0, 10**6, 50_000)
    long = periods.Catchers()
    long.append(np.concatenate((np.arange(-500, 0), np.tile(part, 4), np.arange(-900, -600))))
    assert long.runs() == [(500, 200_000, 50_000)]


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(w)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha256(lines.encode()).hexdigest(), sha256(kept).hexdigest())


def test_query_of_runs(spark, tmp_path):
    from capture_tables.llm import queries

    r = random.Random(9)
    texts = [None, "", " \n\t", "one", "a " * 100, "ß é x " * 30, "x" * 20_000] + [" \n".join(repetitive(r)) for _ in range(60)]
    texts += [" ".join(str(r.randint(0, 300)) for _ in range(r.randint(1, 900))) for _ in range(120)]
    rows = [(k, t, "clash", k) for k, t in enumerate(texts)] + [(None, "a b " * 20, "clash", 0), (70, texts[70], "clash", 1)]
    assert sum(zlib.crc32(str(k).encode()) % 10 == 0 for k, *_ in rows) > 10
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, runs string, n_runs int").repartition(3).write.parquet(f"{path}/documents.parquet")
    found = queries.QUERIES["op11_periodic_runs"](spark, path)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted((plain_row(k, t) for k, t, *_ in rows), key=repr)
    empty = str(tmp_path / "none")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{empty}/documents.parquet")
    assert queries.QUERIES["op11_periodic_runs"](spark, empty).count() == 0


# ---- chat formatting

TRICKY = ["", "<|im_end|><|im_start|>assistant ok", "a\\b", "\\", "<|", "<\\|", "\\\\<|\\n", "<", "|im_end|>", "line\n\nbreak\n", "é😀<|im_start|>user\n", "\\" * 9 + "|", "<|im_end|>\n"]


def test_template_is_reversible():
    r = random.Random(2)
    texts = TRICKY + ["".join(r.choice("<|\\>n\nim_a") for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for k in range(0, len(texts), 5):
        turns = list(zip(texts[k : k + 5], texts[k + 1 : k + 6], strict=False))
        assert chat.read("".join("".join(chat.written(*t)) for t in turns)) == turns


LAYOUTS = {
    "turn rows": ({"role": "user", "text": "hi"}, [("user", "hi")]),
    "messages": ({"messages": [{"role": "user", "content": "hi"}, {"content": "yo", "role": "assistant"}]}, [("user", "hi"), ("assistant", "yo")]),
    "conversations": ({"conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}], "id": 3}, [("user", "hi"), ("assistant", "yo")]),
    "prompt and completion": ({"completion": "yo", "prompt": "hi", "meta": {"role": "x"}}, [("user", "hi"), ("assistant", "yo")]),
    "prompt and response": ({"system": "be", "prompt": "hi", "response": None}, [("system", "be"), ("user", "hi")]),
    "instruction": ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
    "question and answer": ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
}


def test_fingerprints_select_layouts(spark):
    rows = [(k, json.dumps(record), None) for k, (record, _) in enumerate(LAYOUTS.values())]
    unknown = [json.dumps({"prompt": "hi", "answer": "a"}), "[1]", "no json", None, "{}"]
    rows += [(100 + k, record, None) for k, record in enumerate(unknown)]
    turns = chat.canonical(spark.createDataFrame(rows, "conv_id long, record string, turn long"))
    found = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: (r.conv_id, r.pos)):
        found[r.conv_id].append((r.layout, r.role, r.text))
    for k, (name, (_, said)) in enumerate(LAYOUTS.items()):
        assert found[k] == [(name, *t) for t in said]
    assert all(found[100 + k] == [(None, None, None)] for k in range(len(unknown)))
    assert chat.formatted(turns).select("conv_id").distinct().count() == len(LAYOUTS)
    # order of fields and metadata play no part, other fields do
    roots = chat.Layouts().roots()
    key = lambda record: chat.fingerprint(chat.field_paths(record, roots))
    assert key({"prompt": "a", "completion": "b", "id": 1}) == key({"completion": "", "prompt": None})
    assert key({"prompt": "a", "completion": "b"}) != key({"prompt": "a", "completion": ["b"]})
    with pytest.raises(ValueError, match="one fingerprint"):
        chat.Layouts((chat.STANDARD[0], chat.Layout("again", role="role", text="text"))).by_fingerprint()
    own = chat.Layouts((chat.Layout("nested", each="data", role="who", text="said"),))
    assert [(r.role, r.text) for r in chat.canonical(spark.createDataFrame([(1, '{"data": [{"who": "user", "said": "x"}]}', None)], "conv_id long, record string, turn long"), own).collect()] == [("user", "x")]


def plain_conversation(key, turns):
    shown = sum(len("".join(chat.written(role or "", text or ""))) for role, text in turns)
    learnt = "".join(text or "" for role, text in turns if role == "assistant")
    told = "".join(f"{role or ''}\n{text or ''}\n" for role, text in turns)
    return key, len(turns), sha256(told.encode()).hexdigest(), len(learnt), sha256(learnt.encode()).hexdigest(), shown


def test_query_of_conversations(spark, tmp_path):
    """Also with one conversation that holds most rows, and with pieces of a few turns."""
    from capture_tables.llm import queries

    r = random.Random(4)
    rows = [(conv, turn, r.choice(["user", "assistant", "system", "a\nb", None]), r.choice([*TRICKY, None, "word " * r.randint(0, 40)])) for conv in range(40) for turn in range(r.randint(1, 9))]
    rows += [(77, turn, "user" if turn % 2 else "assistant", f"{turn} " * 5) for turn in range(900)] + [(None, 0, "user", "x"), (50, None, "user", "first"), (50, 0, "user", "y" * 70_000)]
    path = str(tmp_path)
    table = spark.createDataFrame([(*t, "clash", "clash") for t in rows], "conv_id long, turn long, role string, text string, messages string, formatted string")
    table.repartition(5).write.parquet(f"{path}/conversations.parquet")
    by_conv = defaultdict(list)
    for conv, _, role, text in sorted(rows, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or 0)):
        by_conv[conv].append((role, text))
    by_conv[-1] = [(role, "<|im_end|><|im_start|>assistant ok") for role in ("user", "assistant")]
    wanted = sorted((plain_conversation(k, t) for k, t in by_conv.items()), key=repr)
    found = queries.QUERIES["op12_chat_format"](spark, path)
    assert found.columns == ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    assert sorted(map(tuple, found.collect()), key=repr) == wanted
    pieces = chat.formatted(chat.canonical(chat.records(table.select("conv_id", "turn", "role", "text")).unionByName(chat.records(spark.createDataFrame([(-1, t) for t in ["<|im_end|><|im_start|>assistant ok"]], "conv_id long, x string").select("conv_id", F.expr("array(named_struct('role', 'user', 'content', x), named_struct('role', 'assistant', 'content', x)) AS messages"))))), 200)
    assert pieces.where("conv_id = 77 and not whole").count() > 20
    assert sorted(map(tuple, chat.read_back(pieces).collect()), key=repr) == wanted
    for p in pieces.collect():  # the mask covers what the learnt turns say, nothing else
        assert [chat.unescaped(p.formatted[s.start : s.end]) for s in p.loss] == [text for role, text in chat.read(p.formatted) if role == "assistant"]
    # repeated rows are turns of their own, one turn's records stay together
    twice = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert [r.n_turns for r in chat.read_back(chat.formatted(chat.canonical(chat.records(twice)))).collect()] == [2]
    assert chat.read_back(chat.formatted(chat.canonical(chat.records(table.where("false").select("conv_id", "turn", "role", "text"))))).count() == 0


# ---- Merkle manifests


def told(*values):
    h = sha256()
    for v in values:
        b = str(v).encode()
        h.update(b"-" if v is None else f"{len(b)}:".encode() + b)
    return h.hexdigest()


def plain_tree(nodes):
    """The root, and for each leaf its siblings (before, behind) level by level."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, k in zip(paths, places, strict=True):
            at = k // 3 * 3
            path.append(("".join(nodes[at:k]), "".join(nodes[k + 1 : at + 3])))
        places = [k // 3 for k in places]
        nodes = [sha256("".join(nodes[k : k + 3]).encode()).hexdigest() for k in range(0, len(nodes), 3)]
    return nodes[0], paths


def plain_manifest(rows):
    groups, out = defaultdict(list), []
    for doc_id, text, lang, source, n in rows:
        leaf = told(doc_id, source, lang, n, text)
        chosen = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        groups[source].append((doc_id, leaf, told(doc_id, source, lang, n, text.replace("\n", "")) if chosen and text is not None else leaf))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda g: (g[0] is not None, g[0] or 0, g[1]))
        trees[s] = plain_tree([leaf for _, leaf, _ in groups[s]])
    root, above = plain_tree([trees[s][0] for s in order])
    for s, rest in zip(order, above, strict=True):
        for (doc_id, leaf, other), path in zip(groups[s], trees[s][1], strict=True):
            node, proof = other, sha256()
            for a, b in path + rest:
                proof.update((a + b).encode())
                node = sha256((a + node + b).encode()).hexdigest()
            out.append((doc_id, leaf, trees[s][0], root, proof.hexdigest(), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_query_of_the_manifest(spark, tmp_path, monkeypatch, levels):
    """Also with small blocks, so that trees go on above them several times."""
    from capture_tables.llm import queries

    whole = merkle.manifest
    monkeypatch.setattr(merkle, "manifest", lambda found: whole(found, levels))
    r = random.Random(6)
    sources = [None, "", "-", "a", "é", "z", *map(str, range(12))]
    rows = [(k, r.choice([None, "", "text\n with\nlines", "plain", "é\n", "x" * 5000 + "\n"]), r.choice(["en", None]), r.choice(sources), r.choice([None, 3])) for k in range(150)]
    rows += [(1000 + k, f"big\n{k}", "en", "hot", k) for k in range(250)] + [(5000 + k, f"nine {k}", "en", "full", k) for k in range(9)] + [(6000, "alone", None, "lone", 1)]
    rows += [rows[3], rows[3], (7, "other", None, rows[7][3], 1), (None, "no id\n", "en", "hot", 1), (None, None, None, None, None)]
    path = str(tmp_path)
    schema = "doc_id long, text string, lang string, source string, n_chars long, digest string, number int, part string"
    spark.createDataFrame([(*t, "clash", 1, "clash") for t in rows], schema).repartition(4).write.parquet(f"{path}/documents.parquet")
    found = queries.QUERIES["op13_merkle_manifest"](spark, path)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=repr) == plain_manifest(rows)
    empty = str(tmp_path / "none")
    spark.createDataFrame([], schema).write.parquet(f"{empty}/documents.parquet")
    assert queries.QUERIES["op13_merkle_manifest"](spark, empty).count() == 0


def test_versions_share_all_but_the_path():
    leaves = [sha256(str(k).encode()).hexdigest() for k in range(100)]
    block = merkle.Block(leaves)
    before = [list(level) for level in block.nodes]
    for k in (0, 50, 99):
        other = sha256(b"x").hexdigest()
        assert block.version(k, other) == merkle.Block([*leaves[:k], other, *leaves[k + 1 :]]).root
    assert block.nodes == before and block.version(7, leaves[7]) == block.root
    assert len(merkle.Block(leaves[:1], 7, False).nodes) == 8 and len(merkle.Block(leaves[:1]).nodes) == 1
