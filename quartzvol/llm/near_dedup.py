"""MinHash near-duplicate detection with odd sketches.

A document's set holds its distinct five-word shingles (A-Z lower-cased, words
between ASCII white space; fewer words make one shingle of the whole sequence).
Two documents are linked when 100 * intersection >= 75 * union, and a
document's group is what it reaches over links.

Method
    1. One pass over the whole texts makes, per document, the set's size and
       digest, 128 MinHash samples cut into 32 bands of 4, and an odd sketch:
       the samples folded into a 256-bit parity map. Documents with equal sets
       collapse into one representative before anything is compared.
    2. In each turn every band key has one member as hub, and members outside
       the hub's component are paired with it. Pairs pass on sizes and on the
       population count of the XOR of their odd sketches, and are confirmed on
       full sets; links merge components (alternating large-star and small-star
       rounds). A turn costs at most one pair for each row of an open bucket,
       and after a few turns large groups have grown together.
    3. Buckets that still hold several components are finished exactly: every
       member outside the bucket's main component meets all others of the
       bucket, with the same tests inside the join. No bucket is capped; large
       ones are salted over many tasks.

A pair at similarity 0.75 shares no band with probability 5e-6; the sketch
test rejects such a pair only beyond 4.5 standard deviations.

Defined results
    Null or empty text, or text of white space only: n_shingles 0, linked with
    nothing, a group of its own. Null doc_id: the row cannot be named, so it is
    linked with nothing, component_id is null and it is kept. Repeated rows
    share one component and, having the same doc_id, the same ``kept``. Columns
    of the input other than the two named are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import tokens
from .components import connected_components
from .workspace import Workspace, hot_among, hot_keys, spread_join

SHINGLE, PERCENT = 5, 75
BANDS, ROWS, SKETCH_WORDS = 32, 4, 4
#: Odd sketches whose similarity estimate lies below this are told apart without their sets.
SKETCH_FLOOR = 0.40
#: Turns of hub pairs before the exact finish.
TURNS = 4
#: Members of each side that meet in one cell of the exact finish.
BLOCK = 1024

_U = np.uint64
_rng = np.random.Generator(np.random.PCG64(77))
_MUL = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | _U(1)
_ADD = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)
_SALT = _rng.integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64)

SIGNATURE = "doc_id long, n_shingles long, d1 long, d2 long, sketch array<long>, bands array<long>"


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The smallest value of each hash function over the set, in slices of bounded size."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at : at + 1024, None] * _MUL
        part += _ADD
        np.minimum(low, part.min(axis=0), out=low)
    return low


def odd_sketches(samples: np.ndarray) -> np.ndarray:
    """Parity of the samples (a row for each document) that fall on each of 256 bits, as four words."""
    bits = SKETCH_WORDS * 64
    place = (tokens.mix(samples ^ _SALT) >> _U(56)).astype(np.int64)
    flat = np.bincount((np.arange(len(samples))[:, None] * bits + place).ravel(), minlength=len(samples) * bits) & 1
    return np.packbits(flat.astype(np.uint8).reshape(len(samples), bits), axis=1).view(np.int64)


def signature_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    raw, offsets = tokens.text_bytes(batch.column(1))
    words, at = tokens.word_hashes(raw, offsets)
    n = batch.num_rows
    sizes = np.zeros(n, dtype=np.int64)
    digests = np.zeros((n, 2), dtype=np.uint64)
    samples = np.zeros((n, BANDS * ROWS), dtype=np.uint64)
    for i in range(n):
        found = tokens.shingle_set(words[at[i] : at[i + 1]], SHINGLE)
        sizes[i] = len(found)
        if len(found):
            digests[i] = found.sum(dtype=np.uint64), (tokens.mix(found + _SALT[0])).sum(dtype=np.uint64)
            samples[i] = minhash(found)
    keyed = samples.reshape(n, BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        keys = tokens.mix(keys * _U(0x9E3779B97F4A7C15) + keyed[:, :, r])
    full = sizes > 0

    def lists(values: np.ndarray) -> pa.Array:
        width = np.where(full, values.shape[1], 0)
        return pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.array(values[full].astype(np.int64).ravel())
        )

    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(sizes), pa.array(digests[:, 0].view(np.int64)), pa.array(digests[:, 1].view(np.int64)), lists(odd_sketches(samples)), lists(keys.view(np.int64))],
        names=["doc_id", "n_shingles", "d1", "d2", "sketch", "bands"],
    )


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        yield signature_batch(batch)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches, 256):
        raw, offsets = tokens.text_bytes(batch.column(1))
        words, at = tokens.word_hashes(raw, offsets)
        found = [tokens.shingle_set(words[at[i] : at[i + 1]], SHINGLE).view(np.int64) for i in range(batch.num_rows)]
        ends = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
        flat = np.concatenate(found) if found else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "shingles"])


def sizes_fit(a: Column, b: Column) -> Column:
    """The larger set is not too large for the threshold."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * PERCENT


def sketches_fit(a: Column, b: Column) -> Column:
    """The odd sketches' estimate of the similarity is not below SKETCH_FLOOR.

    With n bits, k samples and d differing bits the estimate is
    1 + n / (4 k) * ln(1 - 2 d / n); the test is the same bound put on d.
    """
    n, k = SKETCH_WORDS * 64, BANDS * ROWS
    most = int(n / 2 * (1 - np.exp((SKETCH_FLOOR - 1) * 4 * k / n)))
    return reduce(lambda x, y: x + y, [F.bit_count(a[i].bitwiseXOR(b[i])) for i in range(SKETCH_WORDS)]) <= most


def linked(inter: Column, a: Column, b: Column) -> Column:
    return inter * 100 >= (a + b - inter) * PERCENT


def _labelled(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Bucket rows (key, id) with the component that their member is in so far."""
    if roots is None:
        return buckets.withColumn("root", F.col("id"))
    return buckets.join(roots, "id", "left").select("key", "id", F.coalesce("root", "id").alias("root"))


def _open(ws: Workspace, labelled: DataFrame, turn: int) -> DataFrame:
    """The rows of buckets that still hold more than one component, with the buckets' hubs of this turn.

    Buckets are summed up by partial sums, and what is known of a large one
    meets its rows over salts.
    """
    hub = F.min(F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id", "root")).alias("hub")
    keys = ws.save(labelled.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), hub).where("lo < hi").select("key", "n", "hub"), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    return ws.save(spread_join(labelled, keys, ["key"], hot_among(keys, ["key"], "n", total), F.col("id"), "inner"), "open")


def _star_links(ws: Workspace, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b: components) between each bucket's hub and the members outside the hub's component."""
    pairs = rows.where("root != hub.root").select(F.col("hub.id").alias("a"), F.col("hub.root").alias("ra"), F.col("id").alias("b"), F.col("root").alias("rb"))
    pairs = ws.save(pairs.distinct(), "pairs")
    one = sets.select(F.col("id").alias("b"), F.col("sketch").alias("kb"), F.col("shingles").alias("sb"))
    two = sets.select(F.col("id").alias("a"), F.col("sketch").alias("ka"), F.col("shingles").alias("sa"))
    na, nb = F.size("sa"), F.size("sb")
    tests = sizes_fit(na, nb) & sketches_fit(F.col("ka"), F.col("kb"))
    # A member meets at most one hub a band; a hub may meet many members.
    met = spread_join(pairs, two, ["a"], hot_keys(pairs, ["a"], pairs.count()), F.col("b"), "inner").join(one, "b")
    found = met.where(tests).where(linked(F.size(F.array_intersect("sa", "sb")), na, nb))
    return ws.save(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")


def _rest_links(ws: Workspace, rows: DataFrame, sets: DataFrame) -> DataFrame:
    """All links between different components that share a bucket.

    In each bucket the members outside its largest component (minor) meet all
    members. Both sides are cut into parts of about BLOCK members, and each pair
    of parts is a cell of its own, so no cell grows with its bucket. The join's
    condition holds all tests, so it makes no row for a pair that isn't linked.
    """
    counts = rows.groupBy("key", "root").agg(F.count("*").alias("c"))
    keys = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max("c").alias("most"), F.max_by("root", F.struct("c", "root")).alias("main"))
    part = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    keys = ws.save(keys.select("key", "n", "main", part(F.col("n")).alias("columns"), part(F.col("n") - F.col("most")).alias("lines")), "keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    full = spread_join(rows, keys.drop("n"), ["key"], hot_among(keys, ["key"], "n", total), F.col("id"), "inner").join(sets, "id")
    own = lambda parts, seed: F.pmod(F.xxhash64(F.lit(seed), "id"), F.col(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    met = full.select("key", own("columns", 1).alias("x"), every("lines").alias("y"), F.col("id").alias("a"), F.col("sketch").alias("ka"), F.col("shingles").alias("sa"), F.col("root").alias("ra"), (F.col("root") == F.col("main")).alias("in_main"))
    minor = full.where("root != main").select("key", every("columns").alias("x"), own("lines", 2).alias("y"), F.col("id").alias("b"), F.col("sketch").alias("kb"), F.col("shingles").alias("sb"), F.col("root").alias("rb"))
    na, nb = F.size(met["sa"]), F.size(minor["sb"])
    apart = (met["ra"] != minor["rb"]) & (met["in_main"] | (met["a"] < minor["b"]))
    alike = sizes_fit(na, nb) & sketches_fit(met["ka"], minor["kb"]) & linked(F.size(F.array_intersect(met["sa"], minor["sb"])), na, nb)
    found = minor.join(met, (minor["key"] == met["key"]) & (minor["x"] == met["x"]) & (minor["y"] == met["y"]) & apart & alike)
    return ws.save(found.select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "links")


def _merged(ws: Workspace, roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after links between components: (id, root), without each component's smallest id."""
    fresh = connected_components(ws, links)
    if roots is None:
        return fresh
    lifted = fresh.select(F.col("id").alias("root"), F.col("root").alias("higher"))
    return ws.save(roots.join(lifted, "root", "left").select("id", F.coalesce("higher", "root").alias("root")).union(fresh.select("id", "root")), "roots")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs`` (doc_id, text)."""
    ws = Workspace(docs.sparkSession, "near")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    signs = ws.save(docs.mapInArrow(_signatures, SIGNATURE), "signatures")
    named = signs.where("doc_id IS NOT NULL AND n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").alias("id"), "sketch", "bands"))
    reps = ws.save(named.groupBy("d1", "d2").agg(first.alias("r"), F.count("*").alias("copies")).select("d1", "d2", "copies", "r.*"), "representatives")
    rows, sets, roots = reps.select(F.explode("bands").alias("key"), "id"), None, None
    for turn in range(TURNS + 1):
        open_rows = _open(ws, _labelled(rows.select("key", "id"), roots), turn)
        ws.drop(rows)
        rows = open_rows
        if sets is None:
            # Only members of a shared bucket can be linked; their sets are made once, from the whole texts.
            wanted = rows.select(F.col("id").alias("doc_id")).distinct()
            texts = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_sets, "id long, shingles array<long>").dropDuplicates(["id"])
            sets = ws.save(texts.join(reps.select("id", "sketch"), "id"), "sets")
        links = _star_links(ws, rows, sets) if turn < TURNS else _rest_links(ws, rows.select("key", "id", "root"), sets)
        if not links.isEmpty():
            roots = _merged(ws, roots, links)
        elif turn < TURNS:  # no hub has a link left: the exact finish takes the same rows
            links = _rest_links(ws, rows.select("key", "id", "root"), sets)
            roots = roots if links.isEmpty() else _merged(ws, roots, links)
            break
    for done in (rows, sets):
        ws.drop(done)
    if roots is None:
        roots = links.select(F.col("b").alias("id"), F.col("a").alias("root"))
    groups = reps.join(roots, "id", "left").where("copies > 1 OR root IS NOT NULL").select("d1", "d2", "copies", F.coalesce("root", "id").alias("root"))
    signs = signs.select("doc_id", "n_shingles", "d1", "d2")
    out = spread_join(signs, groups.drop("copies"), ["d1", "d2"], hot_among(groups, ["d1", "d2"], "copies", signs.count()), F.col("doc_id"))
    known = F.col("root").isNotNull() & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    component = F.when(known, F.col("root")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
