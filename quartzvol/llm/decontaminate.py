"""Benchmark decontamination by greedy string tiling.

Tokens are maximal runs of letters and digits (any non-ASCII byte counts as a
letter), case-folded for A-Z and the Latin-1 letters. A document is joined with
a benchmark item when they share a seed of ``min_tile`` tokens. For each such
pair tiles are found greedily: the longest match that overlaps no earlier tile
(of equal ones the first in the document, then in the item) is marked again and
again, found by running Karp-Rabin hashes over the tokens not marked yet, until
no match of ``min_tile`` tokens is left. The share of the
item's tokens under tiles is its coverage; order does not matter, so reordered
passages are caught. A document is contaminated by an item at a coverage of
``threshold`` or more.

The benchmark goes to the executors in blocks of at most ``block_bytes`` of
text, one broadcast and one pass over the documents each; nothing is collected
from the documents.

Defined results: null and empty texts, and texts without tokens, match nothing;
an empty table of either kind gives an empty result; an item of fewer than
``min_tile`` tokens can't be told from chance inside a longer text, so it
matches the documents whose tokens are exactly its own (one tile, coverage 1);
repeated items and documents give a row each, with null ids too; ties between
matches go by place. A very long text costs memory in proportion to its length,
whatever its tokens; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens

MIN_TILE, THRESHOLD, BLOCK_BYTES = 5, 0.5, 8 << 20

_GAP = np.ones(256, dtype=bool)
_GAP[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = False
_BITS = 20

RESULT = "doc_id long, item_id long, contaminated boolean, coverage double, matched_tokens long, item_tokens long, n_tiles long, longest_tile long"


def fold_latin(raw: np.ndarray) -> np.ndarray:
    """Lower-case the Latin-1 letters of UTF-8 bytes; A-Z is left to the token kernel."""
    lead = np.flatnonzero(raw[:-1] == 0xC3) + 1
    upper = lead[(raw[lead] >= 0x80) & (raw[lead] <= 0x9E) & (raw[lead] != 0x97)]
    if not len(upper):
        return raw
    out = raw.copy()
    out[upper] += 0x20
    return out


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = tokens.text_bytes(column)
    return tokens.word_hashes(fold_latin(raw), offsets, _GAP)


def _rolling(seq: np.ndarray, free: np.ndarray):
    """Running Karp-Rabin sums over a sequence: a function from a length to the places and hashes of its free windows."""
    up, down = tokens.powers(len(seq) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(seq * up[: len(seq)])])
    marked = np.concatenate([[0], np.cumsum(~free)])

    def windows(size: int) -> tuple[np.ndarray, np.ndarray]:
        last = len(seq) - size + 1
        at = np.flatnonzero(marked[size:] == marked[:last])
        return at, tokens.mix((total[at + size] - total[at]) * down[at])

    return windows


def _matching(text, item, size: int) -> tuple[np.ndarray, ...]:
    """Places and hashes of the text's windows whose hash the item has, and of all the item's windows."""
    at, h = text(size)
    to, g = item(size)
    known = np.isin(h, g)
    return at[known], h[known], to, g


def _mark(seq: np.ndarray, other: np.ndarray, found: tuple[np.ndarray, ...], size: int, free_t: np.ndarray, free_i: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles of one length, by place in the text, then in the item.

    All matches have this length and none is longer, so a window that overlaps
    a new tile covers its first or last token; it never becomes free again, and
    each list of places is walked once.
    """
    at, h, to, g = found
    order = np.lexsort((to, g))
    to, g = to[order], g[order]
    begin, end = np.searchsorted(g, h, "left"), np.searchsorted(g, h, "right")
    next_place: dict[int, int] = {}
    tiles, after = [], 0
    for k in range(len(at)):
        a = int(at[k])
        if a < after:
            continue
        lo, hi = int(begin[k]), int(end[k])
        j = next_place.get(lo, lo)
        while j < hi and not (free_i[to[j]] and free_i[to[j] + size - 1]):
            j += 1
        next_place[lo] = j
        while j < hi:  # one turn, unless two different windows share a hash
            b = int(to[j])
            if free_i[b] and free_i[b + size - 1] and np.array_equal(seq[a : a + size], other[b : b + size]):
                tiles.append((size, a, b))
                free_t[a : a + size] = False
                free_i[b : b + size] = False
                after = a + size
                break
            j += 1
    return tiles


def greedy_tiles(text: np.ndarray, item: np.ndarray, least: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Tiles (length, place in text, place in item), longest first; no token lies in two tiles.

    The longest length with a free match is found by bisection: a match of some
    length holds matches of all smaller ones. A round marks all tiles of that
    length, so there are at most as many rounds as different lengths fit into
    the item, and a round costs sorted hashes of both sequences, however often
    a token repeats.
    """
    text, item = np.asarray(text, np.uint64), np.asarray(item, np.uint64)
    free_t, free_i = np.ones(len(text), bool), np.ones(len(item), bool)
    tiles, most = [], min(len(text), len(item))
    while most >= least:
        one, two = _rolling(text, free_t), _rolling(item, free_i)
        size, lo, hi, found = 0, least, most, None
        while lo <= hi:
            middle = (lo + hi) // 2
            got = _matching(one, two, middle)
            if len(got[0]):
                size, found, lo = middle, got, middle + 1
            else:
                hi = middle - 1
        if not size:
            break
        tiles += _mark(text, item, found, size, free_t, free_i)
        most = size - 1
    return tiles


class Benchmark:
    """Seeds of one block of items, ready for lookups."""

    def __init__(self, ids: list, texts: list[str], least: int):
        self.ids, self.least = ids, least
        words, at = token_hashes(pa.array(texts, pa.string()))
        self.items = [words[at[i] : at[i + 1]] for i in range(len(ids))]
        self.short: dict[bytes, list[int]] = defaultdict(list)
        for i, item in enumerate(self.items):
            if 0 < len(item) < least:
                self.short[item.tobytes()].append(i)
        seeds, owner, place = [], [], []
        for i, item in enumerate(self.items):
            grams = tokens.gram_hashes(item, least)
            seeds.append(grams)
            owner.append(np.full(len(grams), i))
            place.append(np.arange(len(grams)))
        order = np.argsort(flat := np.concatenate([np.zeros(0, np.uint64), *seeds]), kind="stable")
        self.seeds = flat[order]
        self.owner = np.concatenate([np.zeros(0, np.int64), *owner])[order].astype(np.int64)
        self.place = np.concatenate([np.zeros(0, np.int64), *place])[order].astype(np.int64)
        self.bits = np.zeros(1 << _BITS, dtype=bool)
        self.bits[(self.seeds >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Places of ``grams`` that are seeds."""
        near = np.flatnonzero(self.bits[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        at = np.searchsorted(self.seeds, grams[near])
        at[at == len(self.seeds)] = 0
        return near[self.seeds[at] == grams[near]] if len(self.seeds) else near[:0]

    def matches(self, words: np.ndarray, hits: np.ndarray, grams: np.ndarray, threshold: float) -> Iterator[tuple]:
        """(item, coverage, matched, tokens, tiles, longest) of one document."""
        met, which = np.unique(grams, return_inverse=True)  # a repeated seed counts once, so memory follows the benchmark
        first, count = np.searchsorted(self.seeds, met, "left"), np.searchsorted(self.seeds, met, "right")
        count -= first
        pick = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        owner, place, gram = self.owner[pick], self.place[pick], np.repeat(np.arange(len(met)), count)
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        for group in np.split(order, cuts):
            i = int(owner[group[0]])
            item, span = self.items[i], np.arange(self.least)
            covered = np.zeros(len(item), dtype=bool)
            covered[(place[group][:, None] + span).ravel()] = True
            if covered.sum() < threshold * len(item):
                continue  # every tile is made of seeds, so its coverage can't be reached
            own = np.zeros(len(met), dtype=bool)
            own[gram[group]] = True
            used = np.zeros(len(words) + 1, dtype=bool)
            spots = hits[own[which]]
            for k in range(self.least):
                used[spots + k] = True
            used = np.flatnonzero(used)
            gaps = np.flatnonzero(np.diff(used) > 1) + 1
            # Numbers that equal no token of the item part the runs.
            text = np.insert(words[used], gaps, self.strangers(i, len(gaps)))
            tiles = greedy_tiles(text, item, self.least)
            matched = sum(n for n, _, _ in tiles)
            if matched >= threshold * len(item):
                yield self.ids[i], matched / len(item), matched, len(item), len(tiles), tiles[0][0]

    def strangers(self, i: int, n: int) -> np.ndarray:
        """A number that no token of an item has, n times."""
        item = np.sort(self.items[i])
        value = next(v for v in range(len(item) + 1) if item[min(np.searchsorted(item, np.uint64(v)), len(item) - 1)] != v)
        return np.full(n, value, np.uint64)

    def whole(self, words: np.ndarray) -> Iterator[tuple]:
        """Short items whose tokens are all the document's tokens, in order."""
        for i in self.short.get(words.tobytes(), ()):
            yield self.ids[i], 1.0, len(words), len(words), 1, len(words)


def _scanner(shared, threshold: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = shared.value
        least = bench.least
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                words, at = token_hashes(part.column(1))
                grams = tokens.gram_hashes(words, least)
                hits = bench.hits(grams)
                row = np.searchsorted(at, hits, "right") - 1
                fits = hits + least <= at[row + 1]
                hits, row = hits[fits], row[fits]
                few = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) < least)) if bench.short else ()
                if not len(hits) and not len(few):
                    continue
                ids, out = part.column(0).to_pylist(), []
                for r in few:
                    out += [(ids[r], *m) for m in bench.whole(words[at[r] : at[r + 1]])]
                for own in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(row)) + 1) if len(hits) else ():
                    r = int(row[own[0]])
                    got = hits[own]
                    out += [(ids[r], *m) for m in bench.matches(words[at[r] : at[r + 1]], got - at[r], grams[got], threshold)]
                if out:
                    doc, item, cover, matched, n, tiles, longest = map(list, zip(*out, strict=True))
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(doc, pa.int64()), "item_id": pa.array(item, pa.int64()), "contaminated": pa.array([True] * len(doc)), "coverage": pa.array(cover, pa.float64()), "matched_tokens": pa.array(matched, pa.int64()), "item_tokens": pa.array(n, pa.int64()), "n_tiles": pa.array(tiles, pa.int64()), "longest_tile": pa.array(longest, pa.int64())}
                    )

    return scan


def _blocks(spark, benchmark: DataFrame, min_tile: int, block_bytes: int) -> Iterator:
    """Broadcasts of the benchmark's blocks, each of about ``block_bytes`` of text."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        yield spark.sparkContext.broadcast(Benchmark([r["item_id"] for r in rows], [r["text"] for r in rows], min_tile))


def contamination(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each (document, item) pair whose coverage reaches the threshold."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = [docs.mapInArrow(_scanner(shared, threshold), RESULT) for shared in _blocks(docs.sparkSession, benchmark, min_tile, block_bytes)]
    return reduce(DataFrame.union, parts)


def _cleaner(shared, threshold: float):
    scan = _scanner(shared, threshold)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keyed = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(batch.schema.get_field_index("text"))], names=["doc_id", "text"])
            keep = np.ones(batch.num_rows, dtype=bool)
            for found in scan(iter([keyed])):
                keep[found.column(0).to_numpy()] = False
            yield batch.filter(pa.array(keep))

    return clean


def clean_documents(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` (text and any other columns) without contaminated rows; each row is judged where it is read, so nothing is shuffled."""
    for shared in _blocks(docs.sparkSession, benchmark, min_tile, block_bytes):
        docs = docs.mapInArrow(_cleaner(shared, threshold), docs.schema)
    return docs
