from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quartzvol.llm import exact_dedup, near_dedup, tokens
from quartzvol.llm.components import connected_components
from quartzvol.llm.workspace import Workspace

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d1 long, root long, key string"


def docs(spark, rows):
    """Documents with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, None, None, None, 1, 2, "k") for i, t in rows], SCHEMA)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset([tuple(w)] if len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def near_by_hand(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            inter = len(sets[a] & sets[b])
            if 100 * inter >= 75 * (len(sets[a]) + len(sets[b]) - inter):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(5)
    rows, k = [], 0
    for _ in range(12):
        base = words(rng, rng.choice([6, 30, 120])).split()
        for _ in range(rng.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 5])):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(99)}"
            rows.append((k, ("  " if k % 3 else "\n").join(w.upper() if k % 2 else w for w in copy)))
            k += 1
    hub = words(rng, 200).split()
    for _ in range(60):  # a large group of near copies, not all near each other
        copy = list(hub)
        for _ in range(rng.randrange(1, 7)):
            copy[rng.randrange(len(copy))] = f"y{rng.randrange(999)}"
        rows.append((k, " ".join(copy)))
        k += 1
    rows += [(k, None), (k + 1, ""), (k + 2, " \t\n"), (k + 3, "one two"), (k + 4, "ONE  two"), (k + 5, "one two three"), (k + 6, words(rng, 30000)), (k + 3, "one two"), (None, "one two")]
    found = near_dedup.near_duplicates(docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in rows)
    want = near_by_hand(rows)
    for r in found:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(docs(spark, [])).collect() == []
    assert [tuple(r) for r in near_dedup.near_duplicates(docs(spark, [(1, "a b")])).collect()] == [(1, 1, 1, True)]


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.8, 0.9, 0.95):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
            keep = int(1000 * 2 * share / (1 + share))
            b = np.concatenate([a[:keep], rng.integers(0, 1 << 63, 1000 - keep).astype(np.uint64)])
            x, y = near_dedup.odd_sketches(np.stack([near_dedup.minhash(a), near_dedup.minhash(b)]))
            d = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            errors.append(1 + 256 / (4 * 128) * np.log(max(1e-9, 1 - 2 * d / 256)) - share)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_word_hashes_are_those_of_the_words():
    import pyarrow as pa

    rng = random.Random(1)
    texts = ["".join(rng.choice("aBc é\t\n\x0b ") for _ in range(rng.randrange(40))) for _ in range(300)] + [None, ""]
    raw, offsets = tokens.text_bytes(pa.array(texts).slice(3))
    got, at = tokens.word_hashes(raw, offsets)
    seen = {}
    for k, t in enumerate(texts[3:]):
        w = (t or "").encode().lower().split()
        assert at[k + 1] - at[k] == len(w)
        for word, h in zip(w, got[at[k] : at[k + 1]].tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_words_longer_than_a_segment(monkeypatch):
    import pyarrow as pa

    texts = ["a" * 50 + " b", "c", " d e " * 9, "f" * 31]
    whole = tokens.word_hashes(*tokens.text_bytes(pa.array(texts)))
    monkeypatch.setattr(tokens, "SEGMENT", 8)
    cut = tokens.word_hashes(*tokens.text_bytes(pa.array(texts)))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(5, 5)] + [(k, k + 1) for k in range(400, 440)]
    got = dict(connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect())
    parent = {v: v for e in edges for v in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        parent[q] = p
    assert got == {v: find(v) for v in parent if find(v) != v}


def test_exact_duplicates_equal_brute_force(spark):
    rows = [(k, rng) for k, rng in enumerate(["a", "b", "a", "A", "", None, "a", "é", "b" * 100_000, "b" * 100_000])] + [(2, "a"), (None, "z"), (None, "z"), (None, "a")]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    import hashlib

    want = Counter()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids) if ids else None
        want[i, keep, len(groups[t or ""]), keep is None or i == keep, hashlib.sha256((t or "").encode()).hexdigest()] += 1
    got = Counter(tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact_dedup.exact_duplicates(docs(spark, rows)).collect())
    assert got == want
    assert exact_dedup.exact_duplicates(docs(spark, [])).collect() == []


def test_cuckoo_index_against_a_dict():
    rng = random.Random(2)
    index, real = exact_dedup.CuckooIndex(1), {}
    keys = [rng.randbytes(40) for _ in range(3000)] + [b"\0" * 40] + [rng.randbytes(2) + b"\1" * 38 for _ in range(30)]
    for step in range(20_000):
        key = rng.choice(keys)
        if rng.random() < 0.3:
            assert index.delete(key) == (real.pop(key, None) is not None)
        else:
            top = rng.choice([None, step])
            index.fold(key, 1, top)
            n, old = real.get(key, (0, None))
            real[key] = (n + 1, old if top is None else step)
    assert {k: tuple(v) for k, v in index.items()} == real and len(index) == len(real) and all(k in index for k in real)


def test_index_updates(spark):
    key = lambda n: bytes([n]) * 40
    index = spark.createDataFrame([(key(1), 2, 7), (key(2), 1, 3)], exact_dedup.ENTRY)
    added = spark.createDataFrame([(key(2), 9), (key(3), 4)], "key binary, doc_id long")
    removed = spark.createDataFrame([(key(1),), (key(8),)], "key binary")
    got = {bytes(r["key"])[0]: (r["n"], r["top"]) for r in exact_dedup.update_index(index, added, removed).collect()}
    assert got == {2: (2, 9), 3: (1, 4)}


@pytest.mark.parametrize("column", ["key", "root"])
def test_extra_columns_do_not_matter(spark, column):
    rows = docs(spark, [(1, "a b c d e f"), (2, "a b c d e f")])
    assert {r["component_id"] for r in near_dedup.near_duplicates(rows.withColumn(column, F.lit(None))).collect()} == {1}
