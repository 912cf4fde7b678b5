"""Exact deduplication over a cuckoo-filter index of content digests.

Texts are equal when identical after no change (null counts as empty). Of equal
texts the row with the largest doc_id stays.

``CuckooIndex`` is the index: a cuckoo filter of 16-bit fingerprints beside
buckets that hold, for every live slot, the content's full key (SHA-256 and
byte length). A fingerprint hit is only a hint; it is verified against the
bucketed content. Digests can be deleted; when an insertion finds no room the
index doubles and is rebuilt from the keys it stores.

On a table the index is used twice, never over more than one shard:
    * map side: each task folds its own rows into an index, so a text that a
      third of all rows share leaves a task as one entry with its count;
    * reduce side: entries are dealt by digest, and each shard folds them into
      its index, which then holds the shard's live digests.

Defined results: empty texts are equal to each other and to null ones; a very
long text costs its digest only; an empty table gives an empty result; a null doc_id never wins over a number; a group of null ids
only has keep_id null and keeps its rows (there is nothing to tell them apart
by). Rows that repeat both text and the winning doc_id are all kept, since they
are one document. Other columns of the input are not read, so no names clash.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, hot_among, spread_join

SLOTS, MOST_KICKS = 4, 200
#: Distinct digests that a task's index holds before its entries are sent on.
MAP_ENTRIES = 1 << 17


class CuckooIndex:
    """Digest -> [count, largest id], behind a cuckoo filter. A key is a SHA-256 digest and 8 bytes of length."""

    def __init__(self, buckets: int = 256):
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets must be a power of two")
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.buckets = buckets
        self.marks = array("H", bytes(2 * buckets * SLOTS))
        self.keys: list[bytes | None] = [None] * (buckets * SLOTS)
        self.values: list[list | None] = [None] * (buckets * SLOTS)
        self.live = 0

    def _place(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "big") or 1
        one = int.from_bytes(key[2:8], "big") & (self.buckets - 1)
        return mark, one, self._other(one, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & (self.buckets - 1)

    def _find(self, key: bytes) -> int:
        mark, one, two = self._place(key)
        marks, keys = self.marks, self.keys
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if marks[slot] == mark and keys[slot] == key:
                    return slot
        return -1

    def __len__(self) -> int:
        return self.live

    def __contains__(self, key: bytes) -> bool:
        return self._find(key) >= 0

    def get(self, key: bytes) -> list | None:
        slot = self._find(key)
        return self.values[slot] if slot >= 0 else None

    def items(self) -> Iterator[tuple[bytes, list]]:
        return ((k, v) for k, v in zip(self.keys, self.values, strict=True) if k is not None)

    def put(self, key: bytes, value: list) -> None:
        """Insert a key that is not in the index; it grows when there is no room."""
        while not self._try(key, value):
            self._grow()

    def _try(self, key: bytes, value: list) -> bool:
        mark, one, two = self._place(key)
        for bucket in (one, two):
            for slot in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[slot]:
                    self.marks[slot], self.keys[slot], self.values[slot] = mark, key, value
                    self.live += 1
                    return True
        if self.live > 0.95 * self.buckets * SLOTS:
            return False
        path, bucket, held = [], one, (mark, key, value)
        for kick in range(MOST_KICKS):
            slot = bucket * SLOTS + (kick * 7 + held[0]) % SLOTS
            path.append(slot)
            out = (self.marks[slot], self.keys[slot], self.values[slot])
            self.marks[slot], self.keys[slot], self.values[slot] = held
            held = out
            bucket = self._other(bucket, held[0])
            for free in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if not self.marks[free]:
                    self.marks[free], self.keys[free], self.values[free] = held
                    self.live += 1
                    return True
        for slot in reversed(path):  # no room: put all back as it was
            out = (self.marks[slot], self.keys[slot], self.values[slot])
            self.marks[slot], self.keys[slot], self.values[slot] = held
            held = out
        return False

    def _grow(self) -> None:
        entries, size = list(self.items()), self.buckets
        while True:
            size *= 2
            self._clear(size)
            if all(self._try(k, v) for k, v in entries):
                return

    def delete(self, key: bytes) -> bool:
        """Take a live key out; False when it isn't in."""
        slot = self._find(key)
        if slot < 0:
            return False
        self.marks[slot], self.keys[slot], self.values[slot] = 0, None, None
        self.live -= 1
        return True

    def fold(self, key: bytes, count: int, top: int | None) -> None:
        """Count another sight of a key; a verified hit updates its entry, anything else is inserted."""
        held = self.get(key)
        if held is None:
            self.put(key, [count, top])
            return
        held[0] += count
        if top is not None and (held[1] is None or top > held[1]):
            held[1] = top

    def drain(self) -> Iterator[pa.RecordBatch]:
        entries = list(self.items())
        for at in range(0, len(entries), 10_000):
            part = entries[at : at + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())],
                names=["key", "n", "top"],
            )


ENTRY = "key binary, n long, top long"


def _rows(batch: pa.RecordBatch) -> Iterable[tuple]:
    return zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _fold_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = CuckooIndex()
    for batch in batches:
        for key, n, top in _rows(batch):
            index.fold(key, n, top)
        if len(index) > MAP_ENTRIES:
            yield from index.drain()
            index = CuckooIndex()
    yield from index.drain()


def _fold_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come sorted by sub-shard; one index at a time holds one sub-shard's live digests."""
    index, now = CuckooIndex(), None
    for batch in batches:
        for sub, key, n, top in _rows(batch):
            if sub != now:
                yield from index.drain()
                index, now = CuckooIndex(), sub
            index.fold(key, n, top)
    yield from index.drain()


def live_digests(digests: DataFrame) -> DataFrame:
    """(key, n, top) of every distinct key of ``digests`` (key, doc_id)."""
    spark = digests.sparkSession
    mapped = digests.select("key", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("top")).mapInArrow(_fold_rows, ENTRY)
    # Sub-shards: the shuffle deals by the digest's leading bytes; within a task they come one after another.
    sub = F.conv(F.hex(F.substring("key", 9, 2)), 16, 10).cast("int").alias("sub")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = mapped.select(sub, "key", "n", "top").repartition(parts, "sub").sortWithinPartitions("sub")
    return dealt.mapInArrow(_fold_shard, ENTRY)


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text)."""
    ws = Workspace(docs.sparkSession, "exact")
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.concat(F.unhex(F.sha2(text.cast("binary"), 256)), F.unhex(F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))).alias("key"),
    )
    hashed = ws.save(hashed, "digests")
    groups = ws.save(live_digests(hashed).where("n > 1"), "groups")
    out = spread_join(hashed, groups, ["key"], hot_among(groups, ["key"], "n", hashed.count()), F.col("doc_id"))
    keep = F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("top"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, keep.isNull()).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )


def update_index(index: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """A stored index table (key, n, top) after new digests and deletions, shard by shard.

    ``added`` (key, doc_id) brings sights in; ``removed`` (key) takes live
    digests out whole. Removal is applied after addition; unknown keys are ignored.
    """
    spark = index.sparkSession
    plus = added.select("key", F.lit(1).cast("long").alias("n"), F.col("doc_id").alias("top"))
    minus = removed.select("key", F.lit(-1).cast("long").alias("n"), F.lit(None).cast("long").alias("top")).distinct()
    rows = index.select("key", "n", "top").union(plus).union(minus)
    sub = F.conv(F.hex(F.substring("key", 9, 2)), 16, 10).cast("int").alias("sub")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(sub, "key", "n", "top").repartition(parts, "sub").sortWithinPartitions("sub", F.col("n") < 0)
    return dealt.mapInArrow(_apply_shard, ENTRY)


def _apply_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index, now = CuckooIndex(), None
    for batch in batches:
        for sub, key, n, top in _rows(batch):
            if sub != now:
                yield from index.drain()
                index, now = CuckooIndex(), sub
            if n < 0:
                index.delete(key)
            else:
                index.fold(key, n, top)
    yield from index.drain()
