"""DuckDB SQL for the registered corpus queries that SQL can express."""

from __future__ import annotations

import math

from . import decontaminate, urlfilter
from .secrets import BASE, RULES

WARC = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    q AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS last FROM p),
    r AS (SELECT *, strlen(body) >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last AS again FROM q)
    SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
           CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last END AS refers_to
    FROM r
"""

EXACT = """
    SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
           coalesce(doc_id = max(doc_id) OVER g, max(doc_id) OVER g IS NULL) AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

# Full sets of shingles, all pairs that share one, and the closure of the links.
NEAR = r"""
    WITH RECURSIVE words AS (
        SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ), placed AS (
        SELECT doc_id, len(w) AS n, generate_subscripts(w, 1) AS i, unnest(w) AS w1 FROM words
    ), grams AS (
        SELECT doc_id, n, i, concat_ws(' ', w1, lead(w1, 1) OVER p, lead(w1, 2) OVER p, lead(w1, 3) OVER p, lead(w1, 4) OVER p) AS g
        FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)
    ), shingles AS MATERIALIZED (
        SELECT DISTINCT doc_id, g FROM grams WHERE i = 1 OR i <= n - 4
    ), sizes AS MATERIALIZED (
        SELECT doc_id, count(g) AS n FROM documents LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
    ), common AS (
        SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
    ), links AS MATERIALIZED (
        SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE c * 100 >= (p.n + q.n - c) * 75
    ), reach AS (
        SELECT doc_id AS x, doc_id AS y FROM sizes
        UNION
        SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
    ), roots AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
    SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN roots USING (doc_id)
"""

# CRC-32 runs over the bytes by table; the jumps of 17 shards hold those of 16.
SHARDS = """
    WITH RECURSIVE bits AS (
        SELECT range AS i, CAST(range AS BIGINT) AS c, 0 AS k FROM range(256)
        UNION ALL
        SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
    ), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    bytes AS (
        SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size, md5(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h,
               list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST(16 * (instr('0123456789ABCDEF', x[1]) - 1) + instr('0123456789ABCDEF', x[2]) - 1 AS BIGINT)) AS b
        FROM documents
    ), keyed AS (
        SELECT doc_id, size, xor(list_reduce(b, lambda a, v: xor(a >> 8, t[(xor(a, v) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32,
               list_reduce(list_transform(regexp_extract_all(h[1:16], '.'), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS HUGEINT)), lambda a, v: a * 16 + v) AS key,
               list_reduce(list_transform(regexp_extract_all(h[17:32], '.'), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS HUGEINT)), lambda a, v: a * 16 + v) AS place
        FROM bytes, crc
    ), jumps AS (
        SELECT DISTINCT doc_id, key, CAST(0 AS BIGINT) AS j FROM keyed
        UNION ALL
        SELECT doc_id, next, CAST(floor((j + 1) * (2147483648.0::DOUBLE / (CAST(next // 8589934592 AS DOUBLE) + 1))) AS BIGINT)
        FROM (SELECT doc_id, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS next FROM jumps WHERE j < 17)
    ), landed AS (SELECT doc_id, CAST(max(j) FILTER (j < 16) AS INTEGER) AS shard, CAST(max(j) FILTER (j < 17) AS INTEGER) AS grown_shard FROM jumps GROUP BY doc_id)
    SELECT k.doc_id, size, text_crc32, 'key' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY place % 1024, CASE WHEN place >= 9223372036854775808 THEN place - 18446744073709551616 ELSE place END, k.doc_id, text_crc32, size) - 1 AS slot, grown_shard
    FROM keyed k JOIN landed l ON k.doc_id IS NOT DISTINCT FROM l.doc_id
"""


def secret_sql() -> str:
    """Matches and the gaps between them, laid end to end, give the places."""
    parts = []
    for k, rule in enumerate(RULES):
        pattern = rule.pattern.replace("}+", "}").replace("'", "''")  # possessive repetition only saves time
        hits = f"regexp_extract_all(t, '{pattern}')"
        parts.append(
            f"SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, {rule.least} AS least, generate_subscripts({hits}, 1) AS i, unnest(string_split_regex(t, '{pattern}')[:-2]) AS gap, "
            f"unnest({hits}) AS hit, unnest(regexp_extract_all(t, '{pattern}', {rule.group})) AS part FROM texts"
        )
    base = [k for k, rule in enumerate(RULES) if rule.kind in BASE]
    counts = ", ".join(f"count(*) FILTER (k = {k}) AS n_{RULES[k].kind}" for k in base)
    return f"""
        WITH texts AS (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents),
        hits AS ({" UNION ALL ".join(parts)}),
        placed AS (SELECT *, CAST(sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, k ORDER BY i) AS BIGINT) AS stop FROM hits),
        kept AS (SELECT doc_id, k, stop - length(hit) AS start, concat_ws(':', kind, stop - length(hit), stop) AS line FROM placed WHERE length(part) >= least)
        SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(line, ',' ORDER BY start, k) FILTER (k IN ({", ".join(map(str, base))})), '')) AS base_sha256,
               coalesce(string_agg(line, ',' ORDER BY start, k), '') AS spans
        FROM documents d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id
    """


def url_sql() -> str:
    """Every combination of a labelled URL's open items is counted, instead of grown; classes are told by their lists of URLs."""
    ordered = sorted(urlfilter.RULES, key=lambda r: (-len(r[1] + r[2]), r))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v} {h}{p}'" for v, h, p in ordered)
    prior, share, sure = urlfilter.PRIOR, urlfilter.MIN_SUPPORT, urlfilter.MIN_CONFIDENCE
    enough = math.ceil(sure * prior / (1 - sure) - 1e-9)
    strong = f"b >= bound.least AND CAST(b AS DOUBLE) / (n + {prior}) >= {sure}"
    return rf"""
        WITH RECURSIVE cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        parts AS (SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS h, coalesce(rest, '') AS rest FROM cut),
        urls AS (
            SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path FROM parts
        ), judged AS (SELECT *, CASE {fits} END AS fixed FROM urls),
        known AS (SELECT doc_id AS page_id, max(toxic) = 1 AS blocked FROM labels WHERE doc_id IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
        tokens AS (
            SELECT j.*, coalesce(starts_with(fixed, 'block'), blocked) AS blocked,
                   list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'h:' || x),
                       list_transform(list_filter(string_split_regex(translate(path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: 'p:' || x))) AS tokens
            FROM judged j LEFT JOIN known USING (page_id)
        ), labelled AS (SELECT row_number() OVER () AS id, tokens, blocked FROM tokens WHERE blocked IS NOT NULL),
        bound AS (SELECT greatest({enough}, ceil({share} * count(*) - 1e-9)) AS least, count(*) AS total FROM labelled),
        flat AS (SELECT id, blocked, unnest(tokens) AS token FROM labelled),
        classes AS MATERIALIZED (SELECT token, min(token) OVER (PARTITION BY ids) AS item FROM (SELECT token, list(id ORDER BY id) AS ids FROM flat GROUP BY token)),
        held AS MATERIALIZED (SELECT DISTINCT id, blocked, item FROM flat JOIN classes USING (token)),
        counts AS (SELECT item, count(*) AS n, count(*) FILTER (blocked) AS b FROM held GROUP BY item),
        alone AS (SELECT [item] AS items, n, b FROM counts, bound WHERE {strong}),
        open AS MATERIALIZED (SELECT id, blocked, item FROM held JOIN counts USING (item), bound WHERE b >= bound.least AND NOT ({strong})),
        itemsets AS (
            SELECT id, blocked, [item] AS items FROM open
            UNION ALL
            SELECT s.id, s.blocked, list_append(s.items, o.item) FROM itemsets s JOIN open o ON o.id = s.id AND o.item > s.items[-1]
        ), longer AS MATERIALIZED (
            SELECT items, n, b FROM (SELECT items, count(*) AS n, count(*) FILTER (blocked) AS b FROM itemsets WHERE len(items) > 1 GROUP BY items), bound WHERE {strong}
        ), rules AS (
            SELECT items, CAST(b AS DOUBLE) / (n + {prior}) AS confidence, CAST(b AS DOUBLE) / bound.total AS support
            FROM (SELECT * FROM alone UNION ALL SELECT * FROM longer l WHERE NOT EXISTS (SELECT 1 FROM longer s WHERE len(s.items) < len(l.items) AND list_has_all(l.items, s.items))), bound
        ), asked AS (
            SELECT host, path, list(DISTINCT item) AS items FROM (SELECT DISTINCT host, path, unnest(tokens) AS token FROM tokens WHERE fixed IS NULL) JOIN classes USING (token) GROUP BY host, path
        ), best AS (
            SELECT host, path, max(struct_pack(c := confidence, s := support, m := array_to_string(rules.items, '+'))) AS best
            FROM asked JOIN rules ON list_has_all(asked.items, rules.items) GROUP BY host, path
        )
        SELECT page_id, tokens.host AS host, tokens.path AS path, split_part(fixed, ' ', 2) AS rule, CASE WHEN fixed IS NOT NULL THEN split_part(fixed, ' ', 1) WHEN best IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
               best.m AS mined, best.c AS confidence
        FROM tokens LEFT JOIN best ON tokens.host = best.host AND tokens.path = best.path AND fixed IS NULL
        """


def tiling_sql() -> str:
    """All diagonal runs of shared tokens; the longest becomes a tile and cuts the others, again and again."""
    least, threshold = decontaminate.MIN_TILE, decontaminate.THRESHOLD
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xDF)]))
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[0-9A-Za-z\x{{80}}-\x{{10FFFF}}]+')"
    grams = lambda table, key: f"SELECT {key}, i, array_to_string(w[i:i + {least - 1}], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - {least - 2})) AS i FROM {table})"
    inside = lambda x: f"least(n, greatest(0, {x}))"
    return rf"""
        WITH RECURSIVE texts AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
        items AS MATERIALIZED (SELECT row_number() OVER () AS q, item_id, {words} AS w FROM benchmark),
        cells AS (SELECT r, q, t.i AS a, b.i AS b FROM ({grams("texts", "r")}) t JOIN ({grams("items", "q")}) b USING (g)),
        diagonals AS (SELECT *, a - row_number() OVER (PARTITION BY r, q, a - b ORDER BY a) AS run FROM cells),
        step AS (
            SELECT r, q, min(a) AS a, min(b) AS b, CAST(count(*) + {least - 1} AS BIGINT) AS n, false AS tile FROM diagonals GROUP BY r, q, a - b, run
            UNION ALL
            SELECT r, q, a + p.k, b + p.k, p.m, p.tile FROM (
                SELECT r, q, a, b, unnest([struct_pack(k := CAST(0 AS BIGINT), m := CASE WHEN own THEN n ELSE least(x1, x2) END, tile := own),
                    struct_pack(k := CASE WHEN x1 <= x2 THEN y1 ELSE y2 END, m := CASE WHEN own THEN 0 WHEN x1 <= x2 THEN x2 - y1 ELSE x1 - y2 END, tile := false),
                    struct_pack(k := greatest(y1, y2), m := CASE WHEN own THEN 0 ELSE n - greatest(y1, y2) END, tile := false)]) AS p
                FROM (
                    SELECT *, a = ta AND b = tb AS own, {inside("ta - a")} AS x1, {inside("ta - a + tn")} AS y1, {inside("tb - b")} AS x2, {inside("tb - b + tn")} AS y2
                    FROM (SELECT r, q, a, b, n, first_value(a) OVER best AS ta, first_value(b) OVER best AS tb, first_value(n) OVER best AS tn
                          FROM step WHERE NOT tile WINDOW best AS (PARTITION BY r, q ORDER BY n DESC, a, b))
                )
            ) WHERE p.m >= {least}
        ), tiled AS (
            SELECT r, q, sum(n) AS matched, count(*) AS n_tiles, max(n) AS longest FROM step WHERE tile GROUP BY r, q
            UNION ALL
            SELECT r, q, len(texts.w), 1, len(texts.w) FROM texts JOIN items ON texts.w = items.w WHERE len(items.w) BETWEEN 1 AND {least - 1}
        )
        SELECT doc_id, item_id, true AS contaminated, CAST(matched AS DOUBLE) / len(items.w) AS coverage, CAST(matched AS BIGINT) AS matched_tokens, CAST(len(items.w) AS BIGINT) AS item_tokens,
               CAST(n_tiles AS BIGINT) AS n_tiles, CAST(longest AS BIGINT) AS longest_tile
        FROM tiled JOIN texts USING (r) JOIN items USING (q) WHERE matched >= {threshold} * len(items.w)
        """


ORACLE_SQL = {
    "op2_secret_scan": secret_sql(),
    "op3_warc": WARC,
    "op5_url_filter": url_sql(),
    "op6_sharding": SHARDS,
    "op7_minhash_near_dedup": NEAR,
    "op9_benchmark_decontamination": tiling_sql(),
    "op10_exact_dedup": EXACT,
}
