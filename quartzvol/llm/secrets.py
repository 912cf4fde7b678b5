"""Secret scans over an incremental blob ledger.

Every historical version of a text is addressed by the SHA-256 of its bytes. A
ledger keeps, per (blob, rule, rule version), the spans that the rule found, so
a scan looks only at pairs the ledger lacks: new blobs under all rules, old
blobs under new or changed rules. Findings join back to every path that carries
the blob. Only DataFrame functions are used. A blob without findings keeps its
empty entries, so it isn't scanned again; ``scan_documents`` extends a stored
ledger, first by the base rules and then by the added ones. The table is read
once: each text is addressed and tested for hints in one pass that both scans
share. The ledger's files follow rows and bytes, not the session's shuffle
partitions: without Hadoop's native library, executors start processes to set
the permissions of every file they write to a local folder.

A rule finds leftmost matches without overlaps and keeps those whose tested
group is long enough. Spans are code points, end exclusive: ``split`` gives the
pieces between matches and ``regexp_extract_all`` the matches, and running
lengths of both give the places.

Defined results: a null text is the empty blob; rows with a null path id keep
their findings; equal rows give equal rows, and equal texts are one blob; an
empty table gives an empty result. Matches of two kinds may tie or overlap, each
kind is searched on its own. A text of any length and any number of matches is
searched whole, in time that grows with its length. Only doc_id and text are
read, so no other column's name clashes.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, hot_keys, spread_join


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int  #: the group whose length is tested
    least: int
    hint: tuple[tuple[str, ...], ...] = ()  #: literals; a text with a match holds one of each group
    folded: bool = False  #: whether the literals are looked up in the lower-cased text
    probe: str = ""  #: a pattern that every text with a match contains


#: Fixed patterns of the base rules, then the ones this scan adds, in reporting order.
RULES = (
    Rule("assign", 1, r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6, ((":", "="), ("password", "passwd", "secret", "token", "apikey", "api_key")), True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20, (("AKIA",),)),
    Rule("hex", 1, r"[0-9a-f]{24,}+", 0, 24, probe=r"[0-9a-f]{24}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, (("PRIVATE KEY-----",),)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1, ((".eyJ",),)),
)
BASE = ("assign", "access", "hex")
#: Matches that one fold lays out.
CHUNK = 256
SPANS = "array<struct<start:int,stop:int>>"
#: A stored table has one file for so many documents, or for so many bytes of texts to search.
FILE_ROWS = 8192
FILE_BYTES = 2**24


def spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches in a text."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    pieces = F.split(text, rule.pattern, -1)
    lengths = F.zip_with(pieces, whole, lambda gap, hit: F.struct(F.length(gap).alias("gap"), F.coalesce(F.length(hit), F.lit(0)).alias("hit")))
    placed = _let(lengths, _laid)
    kept = F.filter(F.arrays_zip(placed.alias("span"), tested.alias("part")), lambda z: z["part"].isNotNull() & (F.length(z["part"]) >= rule.least))
    return F.transform(kept, lambda z: z["span"])


def may_match(text: Column, rule: Rule) -> Column:
    """A cheap test that every text with a match of the rule passes."""
    where = F.lower(text) if rule.folded else text
    tests = [reduce(lambda a, b: a | b, [F.contains(where, F.lit(x)) for x in group]) for group in rule.hint]
    tests += [F.regexp_like(text, F.lit(rule.probe))] if rule.probe else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _laid(lengths: Column) -> Column:
    """Gaps and matches laid end to end. A fold that appends copies its array at each step, so chunks are laid first and then moved."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        return F.struct((begin + x["hit"]).alias("at"), F.array_append(state["out"], F.struct(begin.alias("start"), (begin + x["hit"]).alias("stop"))).alias("out"))

    def chunk(k: Column) -> Column:
        return F.aggregate(F.slice(lengths, k * CHUNK + 1, CHUNK), start, step)

    def moved(chunks: Column) -> Column:
        ends = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda s, c: F.struct((s["at"] + c["at"]).alias("at"), F.array_append(s["out"], s["at"]).alias("out")))["out"]
        return F.flatten(F.zip_with(chunks, ends, lambda c, by: F.transform(c["out"], lambda x: F.struct((x["start"] + by).alias("start"), (x["stop"] + by).alias("stop")))))

    last = F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))
    return _let(F.transform(F.sequence(F.lit(0), last), chunk), moved)


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def empty_ledger(spark) -> DataFrame:
    """A ledger without rows, made without Python workers."""
    none = spark.range(0).select(F.lit("").alias("blob"), F.lit("").alias("kind"), F.lit(0).alias("version"), F.array().cast(SPANS).alias("spans"))
    return none.where(F.lit(False))


def rule_name(rule: Rule) -> str:
    return f"{rule.kind}:{rule.version}"


def addressed(versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``versions`` with ``blob``, ``hinted`` (names of the rules whose hints the text has) and ``text`` only where there is a hint."""
    text = F.coalesce("text", F.lit(""))
    hinted = F.array_compact(F.array(*[F.when(may_match(text, r), F.lit(rule_name(r))) for r in rules]))
    others = [c for c in versions.columns if c != "text"]
    met = versions.select(*others, blob_id(F.col("text")).alias("blob"), hinted.alias("hinted"), text.alias("text"))
    return met.withColumn("text", F.when(F.size("hinted") > 0, F.col("text")))


def unseen(texts: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``scan`` of ``addressed`` texts (by these rules at least)."""
    names = F.array(*[F.lit(rule_name(r)) for r in rules])
    name = F.concat_ws(":", "kind", F.col("version").cast("string"))
    seen = ledger.where(name.isin([rule_name(r) for r in rules])).groupBy("blob").agg(F.collect_set(name).alias("seen"))
    searched = F.when(F.arrays_overlap("hinted", names), F.col("text"))
    blobs = texts.groupBy("blob").agg(F.first("hinted").alias("hinted"), F.first(searched).alias("text")).join(seen, "blob", "left")
    lack = F.array_except(names, F.coalesce("seen", F.array().cast("array<string>")))

    def row(rule: Rule) -> Column:
        found = F.when(F.array_contains("hinted", rule_name(rule)), spans(F.col("text"), rule)).otherwise(F.array().cast(SPANS))
        return F.when(F.array_contains("lack", rule_name(rule)), F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), found.alias("spans")))

    each = F.array_compact(F.array(*[row(r) for r in rules]))
    lacking = blobs.withColumn("lack", lack).where(F.size("lack") > 0)
    return lacking.select("blob", F.explode(each).alias("x")).select("blob", "x.kind", "x.version", "x.spans")


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New ledger rows (blob, kind, version, spans) for the unseen blob and rule pairs of ``versions`` (text).

    A rule whose hints a text lacks gets its empty row from the address alone.
    Only texts with a hint travel, one copy of each blob from a task, and only
    blobs with an unseen pair are searched.
    """
    ledger = empty_ledger(versions.sparkSession) if ledger is None else ledger
    return unseen(addressed(versions.select("text"), rules), ledger, rules)


def found_by(paths: DataFrame, total: int, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``findings`` of stored ``paths`` (doc_id, blob) of ``total`` rows."""
    places = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(k))])
    k = places[F.concat_ws(":", "kind", F.col("version").cast("string"))]
    hits = ledger.where(k.isNotNull() & (F.size("spans") > 0))
    rows = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), k.alias("k"), s["stop"].alias("stop")))
    by_blob = hits.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list(rows))).alias("found"))
    joined = spread_join(paths, by_blob, ["blob"], hot_keys(paths, ["blob"], total), F.col("doc_id"))
    return joined.select("doc_id", F.coalesce("found", F.array().cast("array<struct<start:int,k:int,stop:int>>")).alias("found"))


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) for every row of ``versions`` (doc_id, text): the current rules' spans of its blob.

    ``found`` is an array of (start, k, stop), ordered by start, then by the rule's place k.
    """
    paths = Workspace(versions.sparkSession, "paths").save(versions.select("doc_id", blob_id(F.col("text")).alias("blob")), "paths")
    return found_by(paths, paths.count(), ledger, rules)


def extended(ws: Workspace, texts: DataFrame, files: int, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A stored ledger with the rows that ``addressed`` texts and ``rules`` add to it, in ``files`` files at most."""
    return ledger.union(ws.save(unseen(texts, ledger, rules).coalesce(files), "ledger"))


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, found) for every row, over a stored ledger: first the base rules scan what it lacks, then the others what it lacks of theirs."""
    ws = Workspace(docs.sparkSession, "secrets")
    ledger = empty_ledger(docs.sparkSession) if ledger is None else ws.save(ledger, "ledger")
    texts = ws.save(addressed(docs.select("doc_id", "text"), rules), "texts")
    total, searched = texts.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    files = max(1, -(-total // FILE_ROWS), -(-searched // FILE_BYTES))
    for part in (tuple(r for r in rules if r.kind in BASE), tuple(r for r in rules if r.kind not in BASE)):
        ledger = extended(ws, texts, files, ledger, part) if part else ledger
    return found_by(texts.select("doc_id", "blob"), total, ledger, rules).coalesce(files)


def digest_columns(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    names = F.array(*[F.lit(r.kind) for r in rules])
    base = [k for k, r in enumerate(rules) if r.kind in BASE]
    line = lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["stop"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda s: s["k"] == k)).cast("long").alias(f"n_{rules[k].kind}")
    base_line = F.array_join(F.transform(F.filter("found", lambda s: s["k"].isin(base)), line), ",")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(base_line.cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("found", line), ",").alias("spans"))
