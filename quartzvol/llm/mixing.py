"""Mixing sources to target weights over a splitting tree of block quotas.

Sizes are word counts. Sources (by code point, null last) share a total by
weight, and no target exceeds ``cap`` times its source's size; what is cut off
is shared again by weight (solved in one pass over the sources, ordered by cap
to weight).

    blocks   A source's documents are dealt by a seeded hash into blocks of at
             most about BLOCK_WORDS words and documents; their number is a
             power of two, so that a seeded bijection of its bits permutes them.
    quotas   A source gives all its blocks for every whole repetition, and of
             one more permutation the leading blocks until its target is met.
             Their number is the source's quota.
    tree     A binary tree halves the quotas among the output shards. At each
             node the left child's number of blocks of every source is drawn
             from the multivariate hypergeometric law (source by source, each
             by inversion), and the right child gets the rest, so quotas are
             exact at every node.
    draw     Shard after shard takes its quota of the source's next permuted
             blocks, so shards are disjoint. What the mix takes of a document
             is the sum of what its block's draws take; in the last block of a
             source documents are taken in a seeded order, and the last in part.
    shuffle  Inside a shard rows follow a seeded permutation (``shuffled``).

A document's block, the block's place and its shard are computed in its row
from its source's row of the plan, so texts are never shuffled to be drawn.
Only DataFrame functions are used. All draws are hashes of a seed and stable
keys, so reruns agree.

Bounds: the plan has one row for each source (it is sorted in one task and the
tree's nodes hold one number for each source); the windows that find a source's
last block see PLACES sums, then one of their parts.

Defined results: null, empty and blank texts have size 0 and are taken 0 words;
a very long text is a block's larger part and is taken like any other; a null
doc_id is drawn by its text's hash; rows that tie in key and size at the cut
share its words evenly, so less than one word a row may be left over; equal rows
are drawn alike; a null source is a source of its own; sources without words
have target 0; an empty table gives an empty result. Columns of the input whose
names are added (ADDED) are replaced, any others are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

WEIGHTS = (3, 1, 2)
#: A block's words and documents together; fixed, so it doesn't follow the table's size.
BLOCK_WORDS = 1 << 14
PLACES = 1024
WORD = r"[^\x20\x09-\x0D]+"
ADDED = ("source_size", "target", "mix_taken", "mix_shards", "mix_order")

def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float, cap: float, weights: tuple = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With the sources ordered by cap to weight, the first k sit at their caps and
    the others at weight * level; level_k is what is left over their weights.
    The right k is the first whose level the next source can bear; later levels
    are lower, so it has the largest of the levels that can be borne.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    ranked = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1))
    limit = F.col("source_size") * F.lit(float(cap))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.encode("source", "UTF-8"))
    all_rows = Window.partitionBy()
    total = F.sum("source_size").over(all_rows) * F.lit(float(share))
    table = ranked.withColumn("limit", limit).withColumn("ratio", F.col("limit") / F.col("w"))
    below = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    table = table.withColumn("level", (total - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / F.sum("w").over(onward))
    table = table.withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(all_rows))
    target = F.when(F.col("level").isNull(), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("w") * F.col("level")))
    return table.select("source", "source_size", target.alias("target"))


def with_sizes(docs: DataFrame, seed: int = 7) -> DataFrame:
    """``docs`` with mix_size (words) and mix_key (the seeded draw key)."""
    return docs.withColumns({
        "mix_size": word_count(),
        "mix_key": F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))),
    })


def source_plan(sizes: DataFrame, share: float, cap: float, weights: tuple) -> DataFrame:
    """Per source: its target, the bits of its block numbers, whole repetitions and the words left over."""
    full = F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")
    plan = source_targets(sizes, share, cap, weights).withColumnRenamed("source", "mix_source")
    plan = plan.join(sizes.select(F.col("source").alias("s"), "rows"), F.col("mix_source").eqNullSafe(F.col("s"))).drop("s")
    bits = F.greatest(F.lit(0), F.ceil(F.log2((F.col("source_size") + F.col("rows")) / F.lit(float(BLOCK_WORDS))))).cast("int")
    plan = plan.select("mix_source", "source_size", "target", F.coalesce(bits, F.lit(0)).alias("mix_bits"), full.alias("mix_full"))
    return plan.withColumn("mix_rest", F.round("target").cast("long") - F.col("mix_full") * F.col("source_size"))


def in_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with their source's row of the plan; the plan has one row a source, and no task gets a source's rows for it."""
    return rows.join(plan, rows["source"].eqNullSafe(plan["mix_source"]), "left").drop("mix_source")


#: SQL of the highest block number; block numbers have mix_bits bits.
_MASK = "(shiftleft(1L, mix_bits) - 1)"


def block(seed: int) -> str:
    """SQL of a row's block number."""
    return f"(xxhash64({seed + 1}, mix_key) & {_MASK})"


def place(number: str, copy: str, seed: int) -> str:
    """SQL of the place of a block in a repetition's permutation: a bijection of numbers of mix_bits bits.

    Rounds of odd multiples, added hashes and folded halves; each can be undone.
    """
    for turn in range(4):
        key = f"xxhash64({seed + 2}, {turn}, source, {copy})"
        moved = f"((({number} * (({key} & 1048575L) | 1L) & {_MASK}) + (shiftrightunsigned({key}, 20) & {_MASK})) & {_MASK})"
        number = f"transform(array({moved}), y -> y ^ shiftright(y, greatest(1, CAST((mix_bits + 1) / 2 AS INT))))[0]"
    return number


def _ln_factorial(n: Column) -> Column:
    """Stirling's series from 16 on, a table below."""
    table = F.array(*[F.lit(math.lgamma(k + 1.0)) for k in range(16)])
    x = n.cast("double") + 1
    series = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n < 16, F.element_at(table, F.least(n, F.lit(15)).cast("int") + 1)).otherwise(series)


def _ln_factorial(n: str) -> str:
    """SQL of ln(n!): Stirling's series at n + 8, less the factors in between."""
    x = f"({n} + 9D)"
    between = " * ".join(f"({n} + {k}D)" for k in range(1, 9))
    return f"(({x} - 0.5D) * ln({x}) - {x} + {0.5 * math.log(2 * math.pi)}D + 1 / (12 * {x}) - 1 / (360 * pow({x}, 3)) + 1 / (1260 * pow({x}, 5)) - 1 / (1680 * pow({x}, 7)) - ln({between}))"


def hypergeometric(population: str, marked: str, draws: str, u: str) -> str:
    """SQL of how many of ``draws`` from a population are marked, by inversion at the uniform ``u``.

    Probabilities are summed over nine standard deviations and nine numbers to
    each side of the mean; what lies beyond has less weight than a double shows.
    """
    n = f"greatest(1D, {population})"
    mean = f"({draws} * ({marked} / {n}))"
    spread = f"(9 + 9 * sqrt(greatest(0D, {mean} * (1 - {marked} / {n}) * ({n} - {draws}) / greatest(1D, {n} - 1))))"
    low = f"greatest(0L, {draws} - ({population} - {marked}), floor({mean} - {spread}))"
    high = f"least({draws}, {marked}, ceil({mean} + {spread}))"
    choose = lambda a, b: f"({_ln_factorial(a)} - {_ln_factorial(b)} - {_ln_factorial(f'({a} - {b})')})"
    first = f"exp({choose(marked, 'lo')} + {choose(f'({population} - {marked})', f'({draws} - lo)')} - {choose(population, draws)})"
    ratio = f"(({marked} - k) * CAST({draws} - k AS DOUBLE) / ((k + 1) * CAST({population} - {marked} - {draws} + k + 1 AS DOUBLE)))"
    step = f"named_struct('p', s.p * coalesce({ratio}, 0D), 'below', s.below + s.p, 'got', coalesce(s.got, CASE WHEN s.below + s.p > {u} THEN k END))"
    pick = f"aggregate(sequence(lo, greatest(lo, {high})), named_struct('p', {first}, 'below', 0D, 'got', CAST(NULL AS BIGINT)), (s, k) -> {step}, s -> coalesce(s.got, {high}))"
    return f"CASE WHEN {marked} <= 0 OR {draws} <= 0 THEN 0L WHEN {draws} >= {population} THEN {marked} ELSE transform(array({low}), lo -> {pick})[0] END"


def _left_quotas(seed: int) -> Column:
    """The left child's quotas: ``total`` blocks drawn without replacement from the node's ``quotas``."""
    u = f"(pmod(xxhash64({seed + 3}, lo, hi, x.source), {1 << 52}L) / {float(1 << 52)}D)"
    got = hypergeometric("z.population", "x.quota", "z.draws", "u")
    after = "named_struct('population', z.population - x.quota, 'draws', z.draws - got, 'out', array_append(z.out, named_struct('source', x.source, 'quota', got)))"
    step = f"transform(array({u}), u -> transform(array({got}), got -> {after})[0])[0]"
    start = "named_struct('population', whole, 'draws', total, 'out', CAST(array() AS ARRAY<STRUCT<source: STRING, quota: BIGINT>>))"
    return F.expr(f"aggregate(quotas, {start}, (z, x) -> {step}, z -> z.out)")


def split_tree(quotas: DataFrame, shards: int, seed: int = 7) -> DataFrame:
    """(source, shard, quota) for every leaf, from (source, quota)."""
    rows = F.array_sort(F.collect_list(F.struct(F.col("source").cast("string").alias("source"), F.col("quota").cast("long").alias("quota"))))
    nodes = quotas.agg(rows.alias("quotas")).select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), "quotas")
    for _ in range((shards - 1).bit_length()):
        inner = nodes.withColumns({"middle": F.expr("CAST(floor((lo + hi) / 2) AS INT)"), "whole": F.expr("aggregate(quotas, 0L, (s, x) -> s + x.quota)")})
        inner = inner.withColumn("total", F.expr("CAST(round(whole * (middle - lo) / (hi - lo)) AS BIGINT)"))
        inner = inner.withColumn("left", F.when(F.col("hi") - F.col("lo") > 1, _left_quotas(seed)))
        right = "zip_with(quotas, left, (q, x) -> named_struct('source', q.source, 'quota', q.quota - x.quota))"
        child = lambda lo, hi, q: f"named_struct('lo', {lo}, 'hi', {hi}, 'quotas', {q})"
        children = F.expr(f"CASE WHEN left IS NULL THEN array({child('lo', 'hi', 'quotas')}) ELSE array({child('lo', 'middle', 'left')}, {child('middle', 'hi', right)}) END")
        nodes = inner.select(F.explode(children).alias("n")).select("n.*")
    return nodes.select(F.col("lo").alias("shard"), F.explode("quotas").alias("q")).select("q.source", "shard", "q.quota")


def _cut(ws: Workspace, narrow: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Per source: where its target ends. (mix_source, cut_place, cut_key, cut_size, cut_words)

    Blocks before cut_place are taken in the last repetition; in that block the
    documents below (cut_key, cut_size), and cut_words of each that equals it.
    Found in three steps, each over bounded groups: sums of PLACES parts of the
    permutation, the blocks of one part, the documents of one block.
    """
    by_source = Window.partitionBy("source")
    placed = in_source(narrow, plan).where("mix_rest > 0 AND mix_size > 0")
    placed = placed.withColumn("place", F.expr(place(block(seed), "mix_full", seed)))
    blocks = ws.save(placed.groupBy("source", "place", "mix_rest", "mix_bits").agg(F.sum("mix_size").alias("words")), "blocks")
    part = F.floor(F.col("place") / F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.col("mix_bits")) / PLACES)).cast("long")
    parts = blocks.groupBy("source", part.alias("part"), "mix_rest").agg(F.sum("words").alias("words"))

    def crossing(rows: DataFrame, order: tuple[str, ...], due: str) -> DataFrame:
        """The row of each source in which the running sum of words reaches ``due``, and what is due in it."""
        before = F.sum("words").over(by_source.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
        rows = rows.withColumn("here", F.col(due) - F.coalesce(before, F.lit(0)))
        return rows.where("here > 0 AND here <= words")

    first = crossing(parts, ("part",), "mix_rest").select(F.col("source").alias("s"), F.col("part").alias("p"), F.col("here").alias("due"))
    near = blocks.join(first, F.col("source").eqNullSafe(F.col("s")) & (part == F.col("p")))
    last = ws.save(crossing(near, ("place",), "due").select(F.col("source").alias("mix_source"), F.col("place").alias("cut_place"), F.col("here").alias("due")), "last")
    inside = placed.join(last, F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("place") == F.col("cut_place")))
    ties = inside.groupBy("source", "mix_key", "mix_size", "due", "cut_place").agg(F.sum("mix_size").alias("words"), F.count("*").alias("n"))
    return crossing(ties, ("mix_key", "mix_size"), "due").select(
        F.col("source").alias("mix_source"), "cut_place", F.col("mix_key").alias("cut_key"), F.col("mix_size").alias("cut_size"), F.floor(F.col("here") / F.col("n")).alias("cut_words")
    )


def mixing_plan(narrow: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, shards: int = 16, seed: int = 7) -> DataFrame:
    """One row a source: target, blocks, cut and the draws at which each shard's quota ends, from (source, mix_size, mix_key)."""
    ws = Workspace(narrow.sparkSession, "mix")
    sizes = ws.save(narrow.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("rows")), "sources")
    plan = ws.save(source_plan(sizes, share, cap, weights), "plan")
    cut = _cut(ws, narrow, plan, seed).withColumnRenamed("mix_source", "s")
    plan = ws.save(plan.join(cut, F.col("mix_source").eqNullSafe(F.col("s")), "left").drop("s"), "cut")
    drawn = F.when(F.col("source_size") > 0, F.col("mix_full") * F.pow(F.lit(2.0), F.col("mix_bits")).cast("long") + F.coalesce(F.col("cut_place") + 1, F.lit(0))).otherwise(0)
    leaves = split_tree(plan.select(F.col("mix_source").alias("source"), drawn.alias("quota")), shards, seed)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("shard", "quota"))), lambda x: x["quota"])
    ends = F.transform(F.sequence(F.lit(1), F.size(ordered)), lambda k: F.aggregate(F.slice(ordered, F.lit(1), k), F.lit(0).cast("long"), lambda s, x: s + x))
    leaves = leaves.groupBy(F.col("source").alias("s")).agg(ends.alias("mix_ends"))
    return ws.save(plan.join(leaves, F.col("mix_source").eqNullSafe(F.col("s")), "left").drop("s"), "quotas")


def mix(docs: DataFrame, plan: DataFrame, seed: int = 7, whole: bool = False) -> DataFrame:
    """``docs`` (of ``with_sizes``, with source and any other columns) and what the mix takes of each row.

    Added: source_size, target, mix_taken (words, repeats counted), mix_shards
    (the output shard of each repetition) and mix_order (the key of the local
    shuffle inside a shard). With ``whole`` the document at the target's edge
    is taken whole when at least half of it is due, and left otherwise.
    """
    edge = "CASE WHEN mix_key < cut_key OR (mix_key = cut_key AND mix_size < cut_size) THEN mix_size WHEN mix_key = cut_key AND mix_size = cut_size THEN cut_words ELSE 0L END"
    if whole:
        edge = f"CASE WHEN ({edge}) * 2 >= mix_size THEN mix_size ELSE 0L END"
    # What repetition c takes of this row, and the shard whose quota holds that draw.
    words = f"CASE WHEN c < mix_full OR spot < cut_place THEN mix_size WHEN spot = cut_place THEN {edge} ELSE 0L END"
    shard = "size(filter(mix_ends, e -> e <= c * shiftleft(1L, mix_bits) + spot))"
    draw = f"transform(array({place('mix_block', 'c', seed)}), spot -> named_struct('shard', {shard}, 'words', {words}))[0]"
    uses = f"CASE WHEN mix_size > 0 THEN filter(transform(sequence(0, mix_full), c -> {draw}), d -> d.words > 0) ELSE CAST(array() AS ARRAY<STRUCT<shard: INT, words: BIGINT>>) END"
    rows = in_source(docs.drop(*ADDED), plan).withColumn("mix_block", F.expr(block(seed)))
    out = rows.withColumn("mix_uses", F.expr(uses))
    out = out.withColumns({
        "mix_taken": F.expr("aggregate(mix_uses, 0L, (s, d) -> s + d.words)"),
        "mix_shards": F.expr("transform(mix_uses, d -> d.shard)"),
        "mix_order": F.xxhash64(F.lit(seed + 64), "mix_key"),
    })
    return out.select(*[c for c in docs.columns if c not in (*ADDED, "mix_key")], *ADDED)


def mix_documents(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple = WEIGHTS, shards: int = 16, seed: int = 7, whole: bool = False) -> DataFrame:
    """``mix`` of a whole table by its own plan; sizes are counted once for the plan and once for the result."""
    sized = with_sizes(docs, seed)
    narrow = Workspace(docs.sparkSession, "sizes").save(sized.select("source", "mix_size", "mix_key"))
    return mix(sized, mixing_plan(narrow, share, cap, weights, shards, seed), seed, whole)


def repeated(mixed: DataFrame) -> DataFrame:
    """One row for each repetition that the mix takes, with its mix_shard and its own mix_order."""
    rows = mixed.select("*", F.posexplode("mix_shards").alias("mix_copy", "mix_shard")).drop("mix_shards")
    return rows.withColumn("mix_order", F.xxhash64("mix_order", "mix_copy"))


def shuffled(rows: DataFrame, shards: int = 16) -> DataFrame:
    """``repeated`` rows dealt by shard and range of the local shuffle, in its order; many tasks write one shard."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = max(0, math.ceil(math.log2(2 * parts / shards)))
    piece = F.shiftright("mix_order", 64 - bits) if bits else F.lit(0)
    return rows.withColumn("mix_piece", piece).repartition(parts, "mix_shard", "mix_piece").sortWithinPartitions("mix_shard", "mix_order").drop("mix_piece")
