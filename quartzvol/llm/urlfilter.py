"""URL filtering by fixed rules and by association rules mined from labels.

A fixed rule (host, path, verdict) fits its host and all subdomains when the
URL's path starts with the rule's; the longest rule wins (by host, then path).
Other URLs are judged by mined rules: token combinations that imply the label
``block`` in the labelled URLs.

    classes  Tokens that occur in exactly the same labelled URLs are one item,
             named by the smallest of them; so the tokens that many URLs share
             as a whole don't multiply into combinations.
    support  A combination counts when blocked URLs of a share of at least
             ``min_support`` of all labelled URLs hold it.
    rule     Its confidence is (blocked URLs that hold it) / (labelled URLs that
             hold it + PRIOR) and must reach ``min_confidence``. The prior stands
             for clean URLs not seen yet, so a handful of URLs never makes a
             rule, in tables of any size.
    pruning  Only the shortest rules count: a combination that holds a smaller
             rule is none. Items that are rules by themselves therefore leave the
             URLs before longer combinations are mined, by Spark's FP-growth
             over the blocked URLs; no length is too long.
    match    An inverted index: each rule is filed under its rarest item, and a
             URL meets only rules filed under one of its items.

Only DataFrame functions (and Spark ML's FP-growth, which runs in the JVM) are
used. FP-growth's work grows with the number of combinations that reach the
support; what is left after classes and single rules decides it.

Defined results: a null, empty or ``://``-less URL has empty host and path, no
tokens, no rule and verdict ``allow``; a very long URL is read whole; null
page_id and equal rows are judged like any other; with no labels nothing is
mined, and an empty table gives an empty result. Of rules that tie in confidence
and support the one with the larger name is reported. Only page_id and url are
read, so no other column's name clashes.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, hot_keys, spread_join

#: Fixed rules (verdict, host, path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.8
#: Clean URLs that every rule is held to have met beside the labelled ones.
PRIOR = 2


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_parts(url: str = "url") -> tuple[Column, Column]:
    """Host (lower-cased A-Z) and path of a URL, empty without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    tail = F.substr(rest, F.length(host) + 1)
    return lower_ascii(host), F.regexp_extract(tail, r"(?s)^([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    out = None
    for verdict, domain, start in ordered:
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(start))
        value = F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def url_tokens(host: Column, path: Column) -> Column:
    """Distinct tokens: every label of the host and every word of the path, marked by where they stand."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(lower_ascii(path), r"[^\p{L}\p{N}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words))


def token_classes(sets: DataFrame) -> DataFrame:
    """(token, item) of all tokens of ``sets`` (tokens, n, b): the item is the smallest token that occurs in the same sets.

    Sets are told by two sums of 64-bit hashes and their number.
    """
    each = sets.select(F.explode("tokens").alias("token"), F.xxhash64(F.lit(1), "tokens").alias("one"), F.xxhash64(F.lit(2), "tokens").alias("two"))
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    held = each.groupBy("token").agg(total("one").alias("one"), total("two").alias("two"), F.count("*").alias("n"))
    items = held.groupBy("one", "two", "n").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens"))
    return items.select(F.explode("tokens").alias("token"), "item")


def itemised(sets: DataFrame, classes: DataFrame, *keys: str) -> DataFrame:
    """``sets`` (keys, tokens, ...) with ``items``, the distinct items of their tokens; sets without a known token are left out."""
    others = [c for c in sets.columns if c not in (*keys, "tokens")]
    found = sets.select(*keys, *others, F.explode("tokens").alias("token")).join(classes, "token")
    return found.groupBy(*keys).agg(F.array_sort(F.collect_set("item")).alias("items"), *[F.first(c).alias(c) for c in others])


def filed(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``rules`` (items, ...) with the item under which they are filed: the one that fewest labelled URLs have."""
    each = rules.select("items", F.explode("items").alias("item")).join(counts, "item")
    return rules.join(each.groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("item")), "items")


def matches(sets: DataFrame, index: DataFrame) -> DataFrame:
    """The rules of ``index`` that ``sets`` (items as ``held``, ...) hold, a row for each."""
    met = sets.withColumn("item", F.explode("held")).join(index, "item").drop("item")
    return met.where(F.size(F.array_except("items", "held")) == 0)


def mine(ws: Workspace, labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(classes, index) from (tokens, blocked): the items of tokens, and the rules (item, items, confidence, support)."""
    sets = labelled.select(F.array_sort("tokens").alias("tokens"), F.col("blocked").cast("long").alias("b")).groupBy("tokens").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    sets = ws.save(sets, "sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    # A rule's blocked URLs alone must make up for the prior, so fewer never pass the confidence.
    least = max(math.ceil(min_support * total - 1e-9), math.ceil(min_confidence * PRIOR / (1 - min_confidence) - 1e-9) if min_confidence < 1 else total + 1, 1)
    classes = ws.save(token_classes(sets), "classes")
    items = ws.save(itemised(sets.where("size(tokens) > 0"), classes, "tokens"), "items")
    counts = ws.save(items.select(F.explode("items").alias("item"), "n", "b").groupBy("item").agg(F.sum("n").alias("n"), F.sum("b").alias("b")), "counts")
    score = F.col("b") / (F.col("n") + PRIOR)
    strong = (F.col("b") >= least) & (score >= min_confidence)
    alone = counts.where(strong).select(F.array("item").alias("items"), "n", "b")
    open_items = counts.where((F.col("b") >= least) & ~(score >= min_confidence)).select("item")
    rest = items.where("b > 0").select("items", "b", F.explode("items").alias("item")).join(open_items, "item")
    rest = rest.groupBy("items").agg(F.array_sort(F.collect_set("item")).alias("open"), F.first("b").alias("b")).where("size(open) > 1")
    rows = ws.save(rest.select("open", F.explode(F.sequence(F.lit(1).cast("long"), "b"))).select("open"), "blocked")
    found = alone
    if not rows.isEmpty():
        frequent = FPGrowth(itemsCol="open", minSupport=min(1.0, (least - 0.5) / rows.count()), minConfidence=1.0).fit(rows).freqItemsets
        longer = ws.save(frequent.where("size(items) > 1").select(F.array_sort("items").alias("items"), F.col("freq").alias("b")), "frequent")
        held = items.select(F.col("items").alias("held"), "n")
        n = matches(held, filed(longer, counts.select("item", F.col("n")))).groupBy("items", "b").agg(F.sum("n").alias("n"))
        found = ws.save(alone.union(shortest(n.where(strong).select("items", "n", "b"), counts)), "rules")
    found = found.select("items", score.alias("confidence"), (F.col("b") / F.lit(max(1, total))).alias("support"))
    return classes, ws.save(filed(found, counts.select("item", "n")), "index")


def shortest(rules: DataFrame, counts: DataFrame) -> DataFrame:
    """``rules`` (items, n, b) that hold no other rule; smaller rules are found through the index, not by pairs."""
    inner = filed(rules.select("items"), counts.select("item", "n"))
    met = matches(rules.select(F.col("items").alias("held")), inner).where(F.size("items") < F.size("held"))
    return rules.join(met.select(F.col("held").alias("items")).distinct(), "items", "left_anti")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined, confidence) for every row of ``pages`` (page_id, url).

    The miner learns from URLs that a fixed rule labels and from ``labels``
    (page_id, blocked), where a fixed rule comes first; rows with nulls are not
    used. ``mined`` names the items of the mined rule of most confidence.
    """
    ws = Workspace(pages.sparkSession, "urls")
    host, path = url_parts()
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    known = labels.where("page_id IS NOT NULL AND blocked IS NOT NULL").groupBy("page_id").agg(F.max("blocked").alias("blocked"))
    urls = urls.withColumn("fixed", fixed_rule(F.col("host"), F.col("path"), rules))
    blocked = F.coalesce(F.col("fixed.verdict") == "block", F.col("blocked"))
    labelled = urls.join(known, "page_id", "left").select(url_tokens(F.col("host"), F.col("path")).alias("tokens"), blocked.alias("blocked"))
    classes, index = mine(ws, ws.save(labelled.where("blocked IS NOT NULL"), "labelled"), min_support, min_confidence)
    # A URL's host and path decide all; each distinct pair is matched once.
    rest = urls.where("fixed IS NULL AND (host != '' OR path != '')").select("host", "path").distinct()
    rest = itemised(rest.withColumn("tokens", url_tokens(F.col("host"), F.col("path"))), classes, "host", "path").withColumnRenamed("items", "held")
    best = matches(rest, index).groupBy("host", "path").agg(F.max(F.struct("confidence", "support", F.array_join("items", "+").alias("mined"))).alias("best"))
    best = ws.save(best.select(F.to_json(F.struct("host", "path")).alias("spot"), "best"), "best")
    urls = urls.withColumn("spot", F.when(F.col("fixed").isNull() & ((F.col("host") != "") | (F.col("path") != "")), F.to_json(F.struct("host", "path"))))
    # Rows that need no lookup have no spot, and are dealt by their page.
    out = spread_join(urls, best, ["spot"], hot_keys(urls, ["spot"], pages.count()), F.struct("page_id", "host", "path"))
    verdict = F.coalesce(F.col("fixed.verdict"), F.when(F.col("best").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("fixed.rule").alias("rule"), verdict.alias("verdict"), F.col("best.mined").alias("mined"), F.col("best.confidence").alias("confidence"))
