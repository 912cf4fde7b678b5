from __future__ import annotations

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quartzvol.llm import pii, secrets, urlfilter
from quartzvol.llm.workspace import Workspace, hot_keys, shared_dir, spread_join

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KINDS = ("assign", "access", "hex")


def secrets_by_hand(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    line = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
    return (*(sum(k == j for _, k, _ in out) for j in range(3)), hashlib.sha256(line.encode()).hexdigest())


def test_secret_spans_equal_brute_force(spark):
    rng = random.Random(11)
    bits = ["token", "SECRET", "=", " ", ":", '"', "'", "api_key", "ApiKey", "abcdef", "é", "😀", "AKIA", "ABCDEFGH01234567", "0123456789abcdef", "deadbeef", ".", "x", "passwd", "\n", "  "]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(14)))) for k in range(1500)] + [(None, None), (5, None), (6, ""), (7, "x" * 200_000 + " token=abcdef"), (7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"blob": F.lit(1), "kind": F.lit("x"), "spans": F.lit(2)})
    got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in secrets.digest_columns(secrets.scan_documents(df)).collect())
    assert got == Counter((i, *secrets_by_hand(t)) for i, t in rows)
    assert secrets.digest_columns(secrets.scan_documents(df.limit(0))).collect() == []


def test_added_rules(spark):
    text = "a -----BEGIN RSA PRIVATE KEY----- b eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"
    r = secrets.digest_columns(secrets.scan_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    assert [s.split(":")[0] for s in r["spans"].split(",")] == ["pem", "jwt"] and (r["n_assign"], r["n_hex"]) == (0, 0)


def test_ledger_scans_only_what_it_lacks(spark):
    df = spark.createDataFrame([(1, "token = abcdefgh"), (2, "token = abcdefgh"), (3, "plain")], "doc_id long, text string")
    first = secrets.scan(df, secrets.empty_ledger(spark))
    assert first.count() == 2 * len(secrets.RULES)
    assert secrets.scan(df, first).count() == 0
    more = df.union(spark.createDataFrame([(4, "secret: 12345678")], df.schema))
    assert {r["kind"] for r in secrets.scan(more, first).collect()} == {r.kind for r in secrets.RULES} and secrets.scan(more, first).select("blob").distinct().count() == 1
    changed = (secrets.RULES[0]._replace(version=2), *secrets.RULES[1:])
    again = secrets.scan(df, first, changed)
    assert {(r["kind"], r["version"]) for r in again.collect()} == {("assign", 2)}
    found = {r["doc_id"]: len(r["found"]) for r in secrets.findings(df, first.union(again), changed).collect()}
    assert found == {1: 1, 2: 1, 3: 0}
    # A stored finding that no rule would make shows that seen pairs are taken from the ledger.
    planted = first.withColumn("spans", F.when(F.col("kind") == "pem", F.expr("array(named_struct('start', 1, 'stop', 2))")).otherwise(F.col("spans")))
    assert {tuple(map(tuple, r["found"][:1])) for r in secrets.scan_documents(df, planted).collect() if r["doc_id"] == 3} == {((1, 3, 2),)}


def test_many_matches_stay_linear(spark):
    df = spark.createDataFrame([(1, "0123456789abcdef01234567 " * 64_000), (2, "token=abcdefgh, " * 20_000)], "doc_id long, text string")
    began = time.time()
    got = secrets.digest_columns(secrets.scan_documents(df)).select("doc_id", "n_hex", "n_assign", F.substring("spans", 1, 26).alias("first"), F.substring_index("spans", ",", -1).alias("last"))
    rows = {r["doc_id"]: r for r in got.collect()}
    assert (rows[1]["n_hex"], rows[2]["n_assign"]) == (64_000, 20_000) and time.time() - began < 30
    assert rows[1]["last"] == f"hex:{25 * 63_999}:{25 * 63_999 + 24}" and rows[2]["first"] == "assign:0:14,assign:16:30,a"


def test_stored_files_follow_rows_not_partitions(spark, monkeypatch):
    rows = [(k, f"text {k % 250} token = abcdef{k % 250:04d}") for k in range(300)] + [(300, None), (301, "plain")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = lambda: {p for p in Path(shared_dir(spark).removeprefix("file:")).rglob("*.parquet") if p.is_file()}
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        for least, most in ((8192, 5), (100, 11)):  # three files of texts; one or four for each of two ledgers
            monkeypatch.setattr(secrets, "FILE_ROWS", least, raising=False)
            before = files()
            found = secrets.digest_columns(secrets.scan_documents(df))
            got = Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found.collect())
            assert got == Counter((i, *secrets_by_hand(t)) for i, t in rows)
            assert len(files() - before) <= most
        # The executors' memory has no Python workers in it.
        assert "ExistingRDD" not in secrets.empty_ledger(spark)._jdf.queryExecution().toString()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_hot_keys_join_apart(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, F.lit(None)).otherwise(F.col("id").cast("string")).alias("key"))
    table = spark.range(0, 3000, 2).select(F.col("id").cast("string").alias("key"), F.col("id").alias("v")).union(spark.createDataFrame([("hot", -1)], "key string, v long"))
    got = spread_join(rows, table, ["key"], hot_keys(rows, ["key"], 3000), F.col("id")).select("id", "key", "v")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, rows.join(table, "key", "left").select("id", "key", "v").collect()))


def pii_by_hand(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(v if k % 2 == 0 else v * 2 - 9 * (v > 4) for k, v in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_base_pii_equals_brute_force():
    rng = random.Random(1)
    bits = ["a", "b", "@", "@", ".", ".", "1", "2", "25", "255", "256", "0", "+", "-", " ", "(", ")", "é", "4111111111111111", "x.y", "_", "000", "😀"]
    for _ in range(20_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(25)))
        assert [s[:3] for s in pii.spans_of(t.encode()) if not s[3]] == pii_by_hand(t), t


@pytest.mark.parametrize(
    ("text", "kind", "shown"),
    [
        ("write john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("é: john at example dot com.", "email", "john at example dot com"),
        ("jоhn@exаmple.com", "email", "jоhn@exаmple.com"),
        ("card four one one one one one one one one one one one one one one one ok", "card", "four" + " one" * 15),
        ("call plus four nine one five one two three four five six", "phone", "plus four nine one five one two three four five six"),
        ("４１１１ １１１１ １１１１ １１１１", "card", "４１１１ １１１１ １１１１ １１１１"),
        ("one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, shown):
    (k, a, b, added), = pii.spans_of(text.encode())
    assert (k, text[a:b], added) == (kind, shown, True)


@pytest.mark.parametrize(
    ("shown", "kind"),
    [
        ("+1 415 555 two six seven one", "phone"),
        ("4111 1111 1111 one one one one", "card"),
        ("plus four four oh two oh seven oh oh", "phone"),
        ("192 point 168 point 1 point 20", "ip"),
        ("john [at  ] example.com", "email"),
        ("john (at\t) example.com", "email"),
    ],
)
def test_gate_lets_few_words_pass(shown, kind):
    assert pii.spans_of(f"so {shown}; ok".encode()) == [(kind, 3, 3 + len(shown), True)]


def test_gate_passes_all_that_is_rewritten():
    rng = random.Random(3)
    bits = ["one", "Two", "oh", "plus", "7", "192", " ", " ", " ", "  ", "\t", "\x1c", "\xa0", "é", "-", "dot", "DOT", "point", "at", "(", "[", ")", "]", "john", "a.b", "@", "_"]
    changed = 0
    for _ in range(40_000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        if pii.rewrite(t) is not None:
            changed += 1
            assert pii._disguised(t.encode()), t
    assert changed > 1000


@pytest.mark.parametrize(
    "shown",
    [
        "john [at] example dot com",
        "john at example [dot] com",
        "john@example dot com",
        "john dot doe at example dot com",
        "john dot doe [at] example dot co [dot] uk",
        "john [dot] doe at mail.example dot com",
        "John DOT a.doe at example．com",
    ],
)
def test_addresses_that_mix_disguises(shown):
    (k, a, b, added), = pii.spans_of(f"é, {shown}, ok".encode())
    assert (k, a, b, added) == ("email", 3, 3 + len(shown), True)


def test_spoken_at_needs_a_disguised_point():
    for text in ("dot: look at example.com", "at home dot", "we look at example.com, dot by dot"):
        assert pii.spans_of(text.encode()) == []
    assert [s[0] for s in pii.spans_of(b"doe@example.com dot net")] == ["email"]


def test_long_chains_stay_linear():
    for text in ("a dot " * 30_000, "a at " * 30_000, "a@b " * 30_000 + "dot", "a" + " " * 100_000 + "dot"):
        began = time.process_time()
        pii.spans_of(text.encode())
        assert time.process_time() - began < 5


def test_plain_prose_has_no_added_spans():
    for text in ("meet me at home, it is one or two or three", "dot by dot", "Привет, мир", "l'été à la plage", "on"):
        assert pii.spans_of(text.encode()) == []


def test_pii_rows(spark):
    rows = [(1, "x a@b.co 1.2.3.4"), (1, "x a@b.co 1.2.3.4"), (None, "é a@b.co"), (3, None), (4, "")]
    got = pii.digest_columns(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)))).collect()
    assert Counter((r["doc_id"], r["n_email"], r["n_ip"], r["spans"]) for r in got) == Counter([(1, 1, 1, "email:2:8,ip:9:16")] * 2 + [(None, 1, 0, "email:2:8"), (3, 0, 0, ""), (4, 0, 0, "")])
    empty = hashlib.sha256(b"").hexdigest()
    assert {r["base_sha256"] for r in got if not r["n_email"]} == {empty}
    assert pii.redact("x a@b.co y", [{"kind": "email", "start": 2, "stop": 8}]) == "x [EMAIL] y"


def disguised(rng, kind):
    """A random identifier of a kind under a random disguise."""
    spelled = "zero one two three four five six seven eight nine".split()
    strange = lambda text, zero: "".join(chr(zero + int(c)) if c.isdigit() else c for c in text)
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def hidden(text):
        return rng.choice([" ".join(spelled[int(c)] for c in text), strange(text, 0xFF10), strange(text, 0x660), "\u200b".join(text)])

    if kind == "email":
        name, host = ("".join(rng.choice("acehops") for _ in range(6)) for _ in range(2))
        if rng.random() < 0.3:
            look = {v: k for k, v in pii.LOOKALIKES.items()}
            return "".join(look.get(c, c) if k % 2 else c for k, c in enumerate(f"{name}@{host}.com"))
        return f"{name}{rng.choice([' at ', ' [at] ', '(at)', ' {AT} ', ' <at> ', '@'])}{host}{rng.choice([' dot ', ' [dot] ', '(dot)', ' (DOT) '])}com"
    if kind == "card":
        head = "4" + number(14)
        return hidden(next(head + c for c in "0123456789" if pii.luhn((head + c).encode())))
    if kind == "phone":
        own = "1" + number(9)
        return rng.choice(["plus " + " ".join(spelled[int(c)] for c in own), "+" + hidden(own)])
    parts = [str(rng.randrange(1, 255)) for _ in range(4)]
    return rng.choice([rng.choice([" dot ", " point ", "[dot]", " (dot) ", "．"]).join(parts), strange(".".join(parts), 0xFF10)])


@pytest.mark.parametrize("kind", pii.KINDS)
def test_random_disguises_are_found_in_place(kind):
    rng = random.Random(kind)
    found = 0
    for _ in range(300):
        shown = disguised(rng, kind)
        text = f"Zum Beispiel {shown} ist, end of text."
        spans = [s for s in pii.spans_of(text.encode()) if s[0] == kind]
        found += any(13 <= s[1] and s[2] <= 13 + len(shown) and s[2] - s[1] >= 0.7 * len(shown) for s in spans)
    assert found >= 0.9 * 300


def test_pii_in_long_texts_and_empty_tables(spark):
    began = time.process_time()
    for n in (20_000, 80_000):
        pii.spans_of(("john [at] example dot com" + " " * n + "dot" + "\t" * n + "[").encode())
    assert time.process_time() - began < 3
    long = "wort " * 200_000 + "john [at] example dot com " + "one two " * 50_000 + "192.168.0.1"
    df = spark.createDataFrame([(1, long), (2, None), (None, "a@b.cc")], "doc_id long, text string").withColumn("spans", F.lit(1))
    rows = {r["doc_id"]: r for r in pii.digest_columns(pii.find_personal_data(df)).collect()}
    assert rows[1]["spans"].startswith("email:1000000:1000025") and rows[1]["n_ip"] == 1 and rows[2]["spans"] == "" and rows[None]["n_email"] == 1
    assert pii.digest_columns(pii.find_personal_data(df.limit(0))).collect() == []


def url_by_hand(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_verdicts(spark):
    urls = ["http://a.Example.COM/en/7x", "https://example.com/en/8", "x.example.net/de/8", "http://m.example.net/de/8?q", "http://net/de/", "http://notcom/en/", "http://a.org/es/1#f", "ftp://É.com?x=://y/en/", "http://", None, "", "://h/p", "http://a.org/esx", "a://b://c/d"]
    want = {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 3: ("example.net/de/8", "block"), 4: ("net/de/", "allow"), 6: ("org/es/", "block")}
    pages = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[0])], "page_id long, url string").withColumns({"host": F.lit("z"), "blocked": F.lit(True)})
    none = spark.createDataFrame([], "page_id long, blocked boolean")
    for r in urlfilter.judge(pages, none).collect():
        k = r["page_id"] if r["page_id"] is not None else 0
        assert (r["host"], r["path"]) == url_by_hand(urls[k])
        rule, verdict = want.get(k, (None, "allow"))
        assert r["rule"] == rule and r["verdict"] == verdict, urls[k]
    assert urlfilter.judge(pages.limit(0), none).collect() == []


def test_mined_rules_catch_what_labels_teach(spark):
    bad = [(k, f"http://x{k % 7}.spam.biz/buy/{k}") for k in range(40)]
    good = [(100 + k, f"http://x{k % 7}.news.biz/read/{k}") for k in range(60)]
    labels = spark.createDataFrame([(k, True) for k, _ in bad[:30]] + [(k, False) for k, _ in good[:50]] + [(1, None), (None, True)], "page_id long, blocked boolean")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(bad + good, "page_id long, url string"), labels).collect()}
    assert all(got[k] == "block" for k, _ in bad) and all(got[k] == "allow" for k, _ in good)


def mined_by_hand(labelled, min_support, min_confidence):
    """Rules as {items: (n, b)}: all combinations of all items, the shortest strong ones."""
    rows = defaultdict(set)
    for k, (tokens, _) in enumerate(labelled):
        for t in tokens:
            rows[t].add(k)
    names = {}
    for t in sorted(rows, reverse=True):
        names[frozenset(rows[t])] = t
    item = {t: names[frozenset(r)] for t, r in rows.items()}
    held = [frozenset(item[t] for t in tokens) for tokens, _ in labelled]
    counted = defaultdict(lambda: [0, 0])
    for items, (_, blocked) in zip(held, labelled, strict=True):
        for size in range(1, len(items) + 1):
            for some in combinations(sorted(items), size):
                counted[frozenset(some)][0] += 1
                counted[frozenset(some)][1] += blocked
    strong = {s: (n, b) for s, (n, b) in counted.items() if b >= min_support * len(labelled) and b / (n + urlfilter.PRIOR) >= min_confidence}
    return {tuple(sorted(s)): v for s, v in strong.items() if not any(other < s for other in strong)}


def test_mining_equals_brute_force(spark):
    for seed in range(3):
        rng = random.Random(seed)
        labelled = []
        for _ in range(400):
            tokens = {f"t{rng.randrange(7)}" for _ in range(rng.randrange(0, 6))}
            tokens |= {"twin1", "twin2"} if rng.random() < 0.2 else set()
            blocked = {"t1", "t2"} <= tokens or {"t3", "t4", "twin1"} <= tokens or rng.random() < 0.05
            labelled.append((sorted(tokens), blocked))
        df = spark.createDataFrame(labelled, "tokens array<string>, blocked boolean")
        for support, confidence in ((0.002, 0.8), (0.03, 0.6)):
            _, index = urlfilter.mine(Workspace(spark, "t"), df, support, confidence)
            got = {tuple(r["items"]): (r["confidence"], r["support"]) for r in index.collect()}
            want = mined_by_hand(labelled, support, confidence)
            assert got == {s: (pytest.approx(b / (n + 2)), pytest.approx(b / 400)) for s, (n, b) in want.items()}
            assert any(len(s) > 1 for s in got)


def test_shared_tokens_do_not_multiply(spark):
    """Forty URLs that share forty tokens, some of them also in clean ones, and one very long URL."""
    shared = "/".join(f"w{k}" for k in range(40))
    urls = [(k, f"http://h{k}.a.biz/{shared}/{k}") for k in range(40)] + [(100 + k, f"http://h{k}.b.biz/w0/w1/{k}") for k in range(300)]
    urls += [(999, "http://c.biz/" + "x/" * 100_000), (1000, f"http://z.c.biz/{shared}")]
    labels = spark.createDataFrame([(k, True) for k in range(40)] + [(100 + k, False) for k in range(290)], "page_id long, blocked boolean")
    began = time.time()
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(urls, "page_id long, url string"), labels).collect()}
    assert time.time() - began < 60  # a slow machine's jobs; combinations of 40 tokens would not end
    assert all(got[k] == "block" for k in [*range(40), 1000]) and all(got[100 + k] == "allow" for k in range(300)) and got[999] == "allow"


def test_a_handful_of_labels_makes_no_rule(spark):
    urls = [(k, f"http://x.spam.biz/buy/{k}") for k in range(12)]
    labels = lambda n: spark.createDataFrame([(k, True) for k in range(n)], "page_id long, blocked boolean")
    pages = spark.createDataFrame(urls, "page_id long, url string")
    assert {r["verdict"] for r in urlfilter.judge(pages, labels(7)).collect()} == {"allow"}
    assert {r["verdict"] for r in urlfilter.judge(pages, labels(8)).collect()} == {"block"}
