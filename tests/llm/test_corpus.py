from __future__ import annotations

import hashlib
import io
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from quartzvol.llm import decontaminate, langid, mixing, sharding, warc
from quartzvol.llm.workspace import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None) for i, t, lang, source in rows], DOCS)


# Mixing


def targets_by_hand(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, held = {}, set()
    total = share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in held]
        left = total - sum(cap * sizes[s] for s in held)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if weight[s] * level > cap * sizes[s]]
        if not over:
            return {s: cap * sizes[s] if s in held else weight[s] * level for s in names}
        held |= set(over)


def mixed_rows(spark, rows, **settings):
    return mixing.mix_documents(docs(spark, rows), **settings)


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["w"] * rng.randrange(1, 90)), None, rng.choice(["a"] * 8 + ["b", "c", "é", "Z", None])) for k in range(900)]
    rows += [(900, None, None, "a"), (901, "  ", None, "b"), (902, "w " * 20_000, None, "a"), (None, "w w w", None, "c"), (5, rows[5][1], None, rows[5][3]), (903, "", None, "empty")]
    out = mixed_rows(spark, rows).withColumns({}).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, *_ in rows)
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = targets_by_hand(sizes), defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["mix_taken"] <= 2 * r["mix_size"] and len(r["mix_shards"]) == -(-r["mix_taken"] // max(1, r["mix_size"])) or r["mix_size"] == 0
        taken[r["source"]] += r["mix_taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = Counter((r["doc_id"], r["mix_taken"], tuple(r["mix_shards"])) for r in mixed_rows(spark, list(reversed(rows))).collect())
    assert again == Counter((r["doc_id"], r["mix_taken"], tuple(r["mix_shards"])) for r in out)


def test_whole_mix_takes_or_leaves(spark):
    rows = [(k, "w " * (1 + k % 50), None, "ab"[k % 2]) for k in range(300)]
    out = mixed_rows(spark, rows, whole=True)
    assert all(r["mix_taken"] % r["mix_size"] == 0 for r in out.collect())
    assert mixing.repeated(out).count() == sum(r["mix_taken"] // r["mix_size"] for r in out.collect())
    assert mixed_rows(spark, []).collect() == []


def spark_hash(*values):
    """Spark's xxhash64 of a row of numbers (int is 32 bits wide where ``np.int32``) and strings."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else int(v).to_bytes(4 if isinstance(v, np.int32) else 8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def place_by_hand(number, bits, source, copy, seed=7):
    mask = (1 << bits) - 1
    for turn in range(4):
        key = spark_hash(np.int32(seed + 2), np.int32(turn), source, np.int32(copy))
        number = (number * ((key & 0xFFFFF | 1) & mask) + ((key % (1 << 64)) >> 20 & mask)) & mask
        number ^= number >> max(1, (bits + 1) // 2)
    return number


def test_taken_and_shards_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 400)
    rng = random.Random(12)
    rows = [(k, "w " * rng.randrange(0, 60), None, rng.choice(["a"] * 6 + ["b", "c", None])) for k in range(800)] + [(801, "w " * 3000, None, "b")]
    sized = mixing.with_sizes(docs(spark, rows)).cache()
    plan = mixing.mixing_plan(sized.select("source", "mix_size", "mix_key"))
    planned = {r["mix_source"]: r for r in plan.collect()}
    out = {r["doc_id"]: r for r in mixing.mix(sized, plan).collect()}
    by_source = defaultdict(list)
    for r in sized.collect():
        by_source[r["source"]].append((r["mix_key"], r["mix_size"], r["doc_id"]))
    want = targets_by_hand({s: sum(n for _, n, _ in rows) for s, rows in by_source.items()})
    quotas = [np.diff([0, *planned[s]["mix_ends"]]) for s in by_source]
    assert max(sum(quotas)) - min(sum(quotas)) <= 4 and len({tuple(q) for q in quotas}) == len(quotas)
    for source, members in by_source.items():
        size, target = sum(n for _, n, _ in members), math.floor(want[source] + 0.5)
        bits = max(0, math.ceil(math.log2((size + len(members)) / 400)))
        full, rest = divmod(target, size)
        draws = []  # every repetition's blocks in permuted order, the last one until the target is met
        blocks = defaultdict(list)
        for key, n, doc in sorted(members):
            blocks[spark_hash(np.int32(8), key) & (1 << bits) - 1].append((n, doc))
        for copy in range(full + 1):
            order = {place_by_hand(b, bits, source, copy): b for b in range(1 << bits)}
            assert sorted(order) == list(range(1 << bits))
            left = rest if copy == full else size
            for at in range(1 << bits):
                if left > 0:
                    draws.append([])
                for n, doc in blocks[order[at]] if left > 0 else ():
                    draws[-1].append((doc, min(n, left)))
                    left -= min(n, left)
        assert planned[source]["mix_ends"][-1] == len(draws)
        taken, shards = Counter(), defaultdict(list)
        for k, draw in enumerate(draws):
            for doc, n in draw:
                if n:
                    taken[doc] += n
                    shards[doc].append(sum(end <= k for end in planned[source]["mix_ends"]))
        for _, _, doc in members:
            assert (out[doc]["mix_taken"], out[doc]["mix_shards"]) == (taken[doc], shards[doc])


def test_tree_splits_exactly_and_at_random(spark):
    quotas = spark.createDataFrame([("a", 300), ("b", 700), (None, 5), ("none", 0)], "source string, quota long")
    rows = mixing.split_tree(quotas, 8, seed=3).collect()
    per, own = Counter(), defaultdict(list)
    for r in rows:
        per[r["shard"]] += r["quota"]
        own[r["source"]].append(r["quota"])
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 3
    assert {s: sum(q) for s, q in own.items()} == {"a": 300, "b": 700, None: 5, "none": 0}
    assert all(20 <= q <= 56 for q in own["a"]) and len(set(own["a"])) > 1


@pytest.mark.parametrize("population, marked, draws", [(50, 20, 10), (5, 5, 3), (40, 3, 39), (100_000, 30_000, 50_000), (1, 0, 1), (9, 4, 0)])
def test_quotas_follow_the_hypergeometric_law(spark, population, marked, draws):
    u = spark.range(4000).selectExpr("(id + 0.5D) / 4000 AS u")
    got = [r[0] for r in u.select(F.expr(mixing.hypergeometric(f"{population}L", f"{marked}L", f"{draws}L", "u"))).collect()]
    total = math.comb(population, draws) if population < 100 else None
    assert min(got) >= max(0, draws - (population - marked)) and max(got) <= min(marked, draws)
    if total:
        for x in range(min(marked, draws) + 1):
            chance = math.comb(marked, x) * math.comb(population - marked, draws - x) / total if draws - x <= population - marked else 0
            assert abs(got.count(x) / 4000 - chance) <= 1.01 / 4000
    else:
        spread = math.sqrt(draws * 0.3 * 0.7 * (population - draws) / (population - 1))
        assert abs(np.mean(got) - draws * 0.3) < spread / 50 and abs(np.std(got) / spread - 1) < 0.02


def test_mixing_replaces_clashing_columns_and_shuffles_inside_shards(spark):
    rows = docs(spark, [(k, "w " * 20, None, "ab"[k % 2]) for k in range(400)]).withColumn("target", F.lit("x")).withColumn("source_size", F.lit(1)).withColumn("shard", F.col("doc_id"))
    out = mixing.mix_documents(rows)
    assert sorted(out.columns) == sorted([*docs(spark, []).columns, "shard", "mix_size", *mixing.ADDED]) and out.schema["target"].dataType.typeName() == "double"
    copies = mixing.repeated(out)
    parts = mixing.shuffled(copies, 4).select(F.spark_partition_id().alias("p"), "mix_shard", "mix_order", "doc_id").collect()
    assert len(parts) == copies.count()
    for p in {r["p"] for r in parts}:
        own = [(r["mix_shard"], r["mix_order"]) for r in parts if r["p"] == p]
        assert own == sorted(own)
    one = [r["doc_id"] for r in sorted((r for r in parts if r["mix_shard"] == parts[0]["mix_shard"]), key=lambda r: r["mix_order"])]
    assert one != sorted(one)


# Sharding


def jump_by_hand(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int(float(b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_equal_brute_force(spark):
    rows = [(k, f"text {k % 9}", None, None) for k in range(-50, 400)] + [(1, None, None, None), (1, None, None, None), (None, "a", None, None), (None, "b", None, None)]
    df = docs(spark, rows).withColumns({"shard": F.lit(1), "slot": F.lit(1), "size": F.lit(1)})
    out = sharding.shard_documents(df).collect()
    assert len(out) == len(rows)
    for r in out:
        key = int(hashlib.md5((str(r["doc_id"]) if r["doc_id"] is not None else "null").encode()).hexdigest()[:16], 16)
        assert r["shard"] == jump_by_hand(key, 16) and r["grown_shard"] == jump_by_hand(key, 17) and r["grown_shard"] in (r["shard"], 16)
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    seen = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out)
    assert seen == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sharding.shard_documents(docs(spark, [])).collect() == []
    with pytest.raises(ValueError):
        sharding.jump_hash(np.zeros(1, np.uint64), 0)


def test_sharding_takes_one_worker_a_task(spark):
    plan = sharding.shard_documents(docs(spark, [(1, "a", None, None)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2  # one for the counts, one for the rows


# Language identification

ALPHABET = {"en": "the and ing tion wh ou er sh", "de": "sch ung ich ein keit ü ß der", "fr": "eau que oi ç é la ment les", "es": "ción ñ rr ll os ado que el"}


def prose(lang, rng, n):
    parts = ALPHABET[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_language_id_on_held_out_documents(spark):
    rng = random.Random(8)
    rows = [(k, prose(lang := rng.choice("en en en de fr es".split()), rng, 30), lang, None) for k in range(600)]
    rows += [(600, None, "en", None), (601, "12 34 !?", "en", None), (602, "", None, None), (603, "Ω", None, None), (604, prose("de", rng, 20_000), None, None), (None, prose("fr", rng, 40), None, None), (0, rows[0][1], "en", None)]
    df = docs(spark, rows).withColumns({"score": F.lit("x"), "held_out": F.lit("x")})
    model = langid.train(df, 60)
    out = langid.identify(df, model).collect()
    assert len(out) == len(rows)
    truth = {i: lang for i, _, lang, _ in rows if i is not None and 0 < i < 600}
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert {r["doc_id"] for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in out)
    by_id = {r["doc_id"]: r["lang_pred"] for r in out}
    assert (by_id[600], by_id[601], by_id[602], by_id[604], by_id[None]) == ("und", "und", "und", "de", "fr") and by_id[603] != "und"
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in rows if i not in (600, 601, 602))


JUNK = ("zqxw vkjh qqpl xkcd zvbn mqwp jjkx wqzv xpqk bvcz hjkq zzxw", "Ελληνικό κείμενο που δεν υπάρχει στο δείγμα και δεν το ξέρει κανείς", "これは日本語の文章です。とても長い文章を書いています。")


def test_rejection_parts_language_from_noise(spark):
    """Measured both ways: nearly all clean rows stay, nearly all noise of some length goes."""
    rng = random.Random(5)
    rows = [(k, prose(lang := rng.choice(list(ALPHABET)), rng, rng.randrange(1, 90)), lang, None) for k in range(500)]
    model = langid.train(docs(spark, rows), 100, reject=True)
    fresh = [(k, prose(rng.choice(list(ALPHABET)), rng, rng.randrange(1, 90)), None, None) for k in range(400)]
    noise = [(k, t, None, None) for k, r in enumerate(fresh) if len(r[1]) > 150 for t in langid.noises(r[1])] + [(900, t, None, None) for t in JUNK]
    assert langid.keep_identified(docs(spark, fresh), model).count() >= 0.99 * len(fresh)
    assert langid.keep_identified(docs(spark, noise), model).count() <= 0.1 * len(noise)
    assert langid.keep_identified(docs(spark, [(1, t, None, None) for t in JUNK]), model).count() == 0
    answers = {r["lang_pred"] for r in langid.identify(docs(spark, noise), model).collect()}
    assert answers <= set(ALPHABET)  # rejection is the stage's; identification always names a learned language


def labelled(n):
    rng = random.Random(6)
    return [(k, prose(lang := rng.choice(list(ALPHABET)), rng, rng.randrange(1, 90)), lang, None) for k in range(n)]


def memory_peak(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_driver_holds_the_learnt_model_only(spark):
    df = docs(spark, labelled(600))
    assert memory_peak(lambda: langid.train(df, 100, reject=True)) < 5e6


def test_learning_holds_one_machine_at_a_time():
    columns = [(k / 160, k, lang, text, k < 80) for k, (_, text, lang, _) in enumerate(labelled(160))]
    rows = pa.Table.from_batches(langid._sampled([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*columns, strict=True)], names=["turn", "tie", "lang", "text", "extra"])]))
    dense = rows.num_rows * langid.BUCKETS * 4
    assert memory_peak(lambda: langid.learn(rows, True)) < dense


def test_learning_does_not_depend_on_partitions(spark):
    rows = labelled(600) + [(None, t, lang, None) for _, t, lang, _ in labelled(700)[600:]]
    df = docs(spark, rows)
    answers = []
    for parts in (df.coalesce(1), df.repartition(7, F.xxhash64("text"))):
        model = langid.train(parts, 60, reject=True)
        answers.append(sorted(((r["lang_pred"], r["score"]) for r in langid.identify(df, model).collect())))
    assert answers[0] == answers[1]


def test_a_crowd_without_ids_leaves_the_sample_to_all_languages(spark):
    rows = labelled(200) + [(None, prose("de", random.Random(k), 20), "de", None) for k in range(2000)]
    df = docs(spark, rows).coalesce(1).orderBy(F.desc("lang"))
    found = {r["lang_pred"] for r in langid.identify(df, langid.train(df, 30)).collect()}
    assert found == set(ALPHABET)


def test_prediction_does_not_depend_on_neighbours():
    rng = random.Random(1)
    texts = [prose(rng.choice(list(ALPHABET)), rng, n).encode() for n in (1, 5, 0, 200, 3)] + [b" x", b"y "]
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = langid.features(np.frombuffer(b"".join(texts), np.uint8), at)
    for k, t in enumerate(texts):
        assert np.array_equal(whole[k], langid.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_without_labels_nothing_is_known(spark):
    df = docs(spark, [(1, "hello", None, None)])
    assert [tuple(r) for r in langid.identify(df, langid.train(df)).collect()] == [(1, zlib.crc32(b"1") % 4 == 2, "und", 0.0)]
    one = docs(spark, [(k, "hello there", "en", None) for k in range(8)])
    assert {(r["lang_pred"], r["score"]) for r in langid.identify(one, langid.train(one)).collect()} == {("en", 1.0)}
    assert langid.identify(docs(spark, []), langid.train(docs(spark, []))).collect() == []


# Decontamination


def tiles_by_hand(text, item, least):
    """Greedy string tiling by comparing all places."""
    mt, mi, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for a in range(len(text)):
            for b in range(len(item)):
                n = 0
                while a + n < len(text) and b + n < len(item) and text[a + n] == item[b + n] and a + n not in mt and b + n not in mi:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        if best[0] < least:
            return tiles
        mt |= set(range(best[1], best[1] + best[0]))
        mi |= set(range(best[2], best[2] + best[0]))
        tiles.append(best)


@pytest.mark.parametrize("letters", [1, 2, 3, 12])
def test_tiles_equal_brute_force(letters):
    rng = random.Random(letters)
    for _ in range(80):
        item = [rng.randrange(letters) for _ in range(rng.randrange(4, 40))]
        text = [rng.randrange(letters) for _ in range(20)] + item[len(item) // 2 :] + [99] + item[: len(item) // 2]
        assert decontaminate.greedy_tiles(text, item, 3) == tiles_by_hand(text, item, 3)


def test_repeated_tokens_stay_cheap(spark):
    began = time.process_time()
    assert decontaminate.greedy_tiles([7] * 5000, [7] * 2000) == [(2000, 0, 0)]
    assert sum(n for n, _, _ in decontaminate.greedy_tiles([1, 2] * 2500 + [3] + [2] * 5000, [2] * 1000 + [1, 2] * 500)) == 2000
    assert time.process_time() - began < 2
    bench = spark.createDataFrame([(1, "ha " * 200), (2, "ha " * 300 + "ho")], "item_id long, text string")
    rows = decontaminate.contamination(docs(spark, [(1, "ha " * 300_000, None, None), (2, "ho " * 9, None, None)]), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["matched_tokens"], r["n_tiles"]) for r in rows) == [(1, 1, 200, 1), (1, 2, 300, 1)]


def test_short_items_match_whole_documents_only(spark):
    bench = spark.createDataFrame([(1, "Yes, it is."), (2, "yes IT is"), (3, "no"), (4, "...")], "item_id long, text string")
    rows = decontaminate.contamination(docs(spark, [(1, "yes it is", None, None), (2, "yes it is so", None, None), (3, "No!", None, None), (4, " . ", None, None), (5, "is it yes", None, None)]), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["coverage"]) for r in rows) == [(1, 1, 1.0), (1, 2, 1.0), (3, 3, 1.0)]


def test_leaks_are_caught_also_reordered(spark):
    rng = random.Random(6)
    item = [f"w{rng.randrange(500)}" for _ in range(30)]
    other = [f"v{rng.randrange(500)}" for _ in range(30)]
    fill = lambda n: " ".join(f"z{rng.randrange(900)}" for _ in range(n))
    texts = {
        1: f"{fill(40)} {' '.join(item).upper()}! {fill(30)}",
        2: f"{fill(9)} {' '.join(item[20:])}, {fill(5)} {' '.join(item[:10])}. {fill(4)} {' '.join(item[10:20])}",
        3: fill(200),
        4: f"{fill(20)} {' '.join(item[:8])} {fill(20)}",
        5: None,
        6: "",
        7: fill(20_000) + " " + " ".join(other),
        8: " ".join(item) + " " + " ".join(other),
    }
    bench = spark.createDataFrame([(10, " ".join(item)), (11, " ".join(other)), (12, None), (13, "too short"), (14, "")], "item_id long, text string")
    df = docs(spark, [(k, t, None, None) for k, t in texts.items()] + [(1, texts[1], None, None), (None, texts[1], None, None)]).withColumn("item_id", F.lit(3))
    want = Counter({(1, 10): 2, (2, 10): 1, (7, 11): 1, (8, 10): 1, (8, 11): 1, (None, 10): 1})
    assert Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contamination(df, bench).collect()) == want
    assert Counter((r["doc_id"], r["item_id"]) for r in decontaminate.contamination(df, bench, block_bytes=40).collect()) == want
    assert sorted(r["doc_id"] for r in decontaminate.clean_documents(df, bench, block_bytes=40).collect()) == [3, 4, 5, 6]
    assert decontaminate.contamination(df, bench.limit(0)).collect() == [] and decontaminate.contamination(df.limit(0), bench).collect() == []


# WARC


def test_round_trip_equals_brute_force(spark):
    rng = random.Random(9)
    long = ["x" * 1000, "é" * 700, "".join(rng.choice("<p>ab ") for _ in range(5000))]
    rows = [(k, f"http://h/{k}\r\nX: y", rng.choice([*long, "small", "small", "", None])) for k in range(200)] + [(500, None, "y" * 999), (501, None, "y" * 999), (None, "u", long[0]), (199, "again", long[0]), (600, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "last": F.lit(2), "payload": F.lit(3)})
    last = defaultdict(int)
    for i, _, h in rows:
        if i is not None:
            last[h or ""] = max(last[h or ""], i)
    count = Counter(h or "" for _, _, h in rows)

    def by_hand(i, h):
        h = h or ""
        raw = h.encode()
        again = len(raw) >= 1000 and count[h] > 1 and i != last[h]
        return i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last[h] if again else None

    fields = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    for size in (warc.ARCHIVE_BYTES, 2000):
        got = Counter(tuple(r[f] for f in fields) for r in warc.round_trip(spark, pages, size).collect())
        assert got == Counter(by_hand(i, h) for i, _, h in rows)
    assert warc.round_trip(spark, pages.limit(0)).collect() == []


def _archive(dictionary, records):
    out = io.BytesIO()
    writer = warc.ArchiveWriter(out, dictionary)
    for r in records:
        writer.add(r)
    return out.getvalue()


def test_archive_with_dictionary_streams_record_by_record(monkeypatch):
    rng = random.Random(2)
    template = " ".join(f"<div class='c{rng.randrange(10**6)}'>part {k}</div>" for k in range(60))
    samples = [f"<html><body>{template}{rng.randbytes(40).hex()}</body>".encode() for _ in range(200)]
    dictionary = zstandard.train_dictionary(4096, samples).as_bytes()
    records = [warc.build_record(k, "http://h", s, hashlib.sha1(s).hexdigest(), "response", None) for k, s in enumerate([*samples[:20], b"", rng.randbytes(400_000), b"\0" * 500_000])]
    raw = _archive(dictionary, records)
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little") and len(raw) < len(_archive(None, records))
    monkeypatch.setattr(warc, "CHUNK", 7)
    assert [c for _, c in warc.frames(io.BytesIO(raw))] == records
    assert [warc.parse_record(c)["page_id"] for _, c in warc.frames(io.BytesIO(_archive(None, records)))] == list(range(23))
    *good, (at, error) = warc.frames(io.BytesIO(raw[:-3]))
    assert [c for _, c in good] == records[:-1] and "ends inside" in str(error) and at > 0
    assert ["neither" in str(e) for _, e in warc.frames(io.BytesIO(b"not an archive"))] == [True]


def test_flipped_bytes_cost_their_record_only():
    rng = random.Random(3)
    samples = [" ".join(f"word{rng.randrange(300)}" for _ in range(80)).encode() for _ in range(300)]
    dictionary = zstandard.train_dictionary(2048, samples).as_bytes()
    records = [warc.build_record(k, "http://h", s, hashlib.sha1(s).hexdigest(), "response", None) for k, s in enumerate(samples[:60])]
    for trial in range(150):
        raw = bytearray(_archive(dictionary if trial % 2 else None, records))
        size = int.from_bytes(raw[4:8], "little") + 8 if trial % 2 else 0
        raw[rng.randrange(size, len(raw))] ^= 1 << rng.randrange(8)
        found = [c for _, c in warc.frames(io.BytesIO(bytes(raw)))]
        good = [c for c in found if isinstance(c, bytes) and c in records]
        assert len(good) >= 59 and good == [r for r in records if r in good]
        assert all(c in records for c in found if isinstance(c, bytes) and _valid(c))
    wrong = zstandard.train_dictionary(2048, [s[::-1] for s in samples]).as_bytes()
    mixed = _archive(wrong, [])[:] + _archive(dictionary, records)[size:]
    assert all(isinstance(c, warc.DamagedFrame) or not _valid(c) for _, c in warc.frames(io.BytesIO(mixed)))


def _valid(record):
    try:
        return bool(warc.parse_record(record))
    except ValueError:
        return False


def test_small_records_read_in_linear_time():
    record = warc.build_record(1, "http://h", b"x", hashlib.sha1(b"x").hexdigest(), "response", None)
    raw = _archive(None, [record] * 40_000)
    began = time.process_time()
    assert sum(1 for _ in warc.frames(io.BytesIO(raw))) == 40_000 and time.process_time() - began < 6


def test_damaged_records_are_reported(spark, tmp_path):
    good = warc.build_record(1, "http://h", b"body", hashlib.sha1(b"body").hexdigest(), "response", None)
    bad = [good.replace(b"Content-Length: 4", b"Content-Length: 5"), good.replace(b"body", b"bodx"), good[:-1], good.replace(b"WARC-Date", b"X-Date"), b"HTTP/1.1 200"]
    path = tmp_path / "a.warc.zst"
    raw = bytearray(_archive(None, [good, *bad, good, good]))
    raw[-20] ^= 255  # the last frame doesn't decode
    path.write_bytes(bytes(raw))
    manifest = spark.createDataFrame([(str(path),)], "path string")
    rows = warc.read_archives(manifest, f"file://{tmp_path}").orderBy("record_offset").collect()
    assert [r["error"] is None for r in rows] == [True, *[False] * 5, True, False] and bytes(rows[0]["payload"]) == b"body"
    with pytest.raises(Exception, match="offset"):
        warc.read_archives(manifest, f"file://{tmp_path}", strict=True).collect()


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_exact_and_near import near_by_hand

    rng = random.Random(12)
    rows = [(k, prose(lang := rng.choice(list(ALPHABET)), rng, rng.randrange(5, 80)), lang, f"s{k % 4}") for k in range(240)]
    rows += [(240 + k, rows[k][1], rows[k][2], "s1") for k in range(20)] + [(300, None, "en", "s0"), (301, "123", "en", "s0")]
    rows += [(302 + k, t, None, "s0") for k, t in enumerate(JUNK)]  # a test for letters alone would keep these
    leak = prose("en", rng, 40)
    rows += [(310, prose("en", rng, 30) + " " + leak, "en", "s2"), (311, leak + " " + prose("en", rng, 30), "en", "s3")]
    docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    ws, stage_in, kept = Workspace(spark, "t"), spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = ws.save(stage(spark, stage_in, str(tmp_path)), name)
        if name != "sharding":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        kept[name], stage_in = [(r["doc_id"], r["text"]) for r in out.select("doc_id", "text").collect()], out
    known = [(i, t) for i, t, *_ in rows if not 300 <= i < 305]
    assert Counter(kept["language_id"]) == Counter(known)
    groups = near_by_hand(known)
    alone = [(i, t) for i, t in known if groups[i][1] == i]
    assert Counter(kept["near_dedup"]) == Counter(alone)
    assert Counter(kept["decontamination"]) == Counter((i, t) for i, t in alone if i not in (310, 311))
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(Counter(kept["mixing"]).values()) <= 2
    assert Counter(kept["sharding"]) == Counter(kept["mixing"])
    assert Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter(kept["sharding"])
