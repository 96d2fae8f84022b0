"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from textsentry.llm import mixing, sharding

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(column: str) -> str:
    low = f"translate(coalesce({column}, ''), '{_UP}', '{_LOW}')"
    return f"regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


DECONTAMINATE = f"""
WITH b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
  bw AS (
    SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS win
    FROM (SELECT item_id, w, least(13, len(w)) AS k FROM b WHERE len(w) > 0),
      LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
  lens AS (SELECT DISTINCT k FROM bw),
  d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
  dw AS (
    SELECT doc_id, k, p, array_to_string(w[p:p + k - 1], ' ') AS win
    FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS p)),
  hits AS (SELECT doc_id, p, k, item_id FROM dw JOIN bw USING (k, win)),
  hit_words AS (SELECT DISTINCT doc_id, unnest(range(p, p + k)) AS x FROM hits),
  n AS (SELECT doc_id, count(*) AS n_hit FROM hit_words GROUP BY doc_id),
  i AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS items FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(len(items), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""

# CRC-32 byte by byte, with its table made from the polynomial.
_STEP = "CASE WHEN {x} % 2 = 1 THEN xor({x} >> 1, 3988292384) ELSE {x} >> 1 END"
_TABLE = "SELECT i AS t0, i::BIGINT AS t FROM range(256) r(i)"
for _ in range(8):
    _TABLE = f"SELECT t0, {_STEP.format(x='t')} AS t FROM ({_TABLE})"


def crc32(column: str) -> str:
    """SQL for the checksum of a text column, given ``tab.crc``, the table as a list."""
    state = (
        f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex({column}), '..'), "
        "lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c >> 8, crc[(xor(c & 255, b) + 1)::BIGINT]))"
    )
    return f"xor({state}, 4294967295)"


SHARD = f"""
WITH tab AS MATERIALIZED (SELECT list(t ORDER BY t0) AS crc FROM ({_TABLE})),
  r AS (
    SELECT doc_id, source, coalesce(strlen(text), 0)::BIGINT + 1 AS size,
      {crc32("coalesce(text, '')")} AS text_crc32,
      md5('{sharding.SEED}|' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents, tab),
  f AS (
    SELECT *, (row_number() OVER (PARTITION BY source ORDER BY k, doc_id) - 0.5::DOUBLE)
      / count(*) OVER (PARTITION BY source) AS frac FROM r),
  g AS (
    SELECT *, row_number() OVER (ORDER BY frac, k, source, doc_id) - 1 AS pos, count(*) OVER () AS n FROM f),
  s AS (SELECT *, (pos * {sharding.SHARDS}) // n AS sh FROM g)
SELECT doc_id, size, text_crc32, 'rows' AS law, sh::INT AS shard,
  (pos - (sh * n + {sharding.SHARDS - 1}) // {sharding.SHARDS})::BIGINT AS slot,
  NULL::INT AS grown_shard, source
FROM s
"""


def _domain(source: str) -> str:
    number = f"TRY_CAST(regexp_extract({source}, '([0-9]{{1,9}})$', 1) AS BIGINT)"
    return (
        f"CASE WHEN {source} IS NULL OR {number} IS NULL THEN 'other' WHEN {number} = 0 THEN 'web' "
        f"WHEN {number} < 10 THEN 'books' ELSE 'reference' END"
    )


def _weights(path: list[str]) -> str:
    named = {k: v for k, v in mixing.WEIGHTS.items() if len(k) == len(path)}
    cases = " ".join(
        "WHEN " + " AND ".join(f"{c} = '{x}'" for c, x in zip(path, k, strict=True)) + f" THEN {v}"
        for k, v in named.items()
    )
    return f"CASE {cases} ELSE 1 END" if cases else "1"


def mix_ctes(share: float, epochs: int, seed: str, documents: str = "documents") -> str:
    """CTEs up to ``picked``: doc_id, tree columns, n_tokens, epoch, cum_tokens, leaf_budget."""
    tree = list(mixing.TREE)
    ctes = [
        f"""mixed AS (
    SELECT doc_id, {_domain("source")} AS domain, lang, source,
      coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM {documents})""",
        "leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS supply FROM mixed GROUP BY ALL)",
        f"lv0 AS (SELECT floor(coalesce(sum(supply), 0) * {float(share)}::DOUBLE)::BIGINT AS budget FROM leaf)",
    ]
    for depth in range(1, 4):
        path, parents = tree[:depth], tree[: depth - 1]
        cols, last = ", ".join(path), path[-1]
        on = " AND ".join(f"n.{p} IS NOT DISTINCT FROM p.{p}" for p in parents) or "true"
        part = f"PARTITION BY {', '.join(parents)} " if parents else ""
        upto = f"({part}ORDER BY fill, {last} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        whole = f"({part})"
        ctes.append(
            f"""nd{depth} AS (SELECT {cols}, sum(supply)::BIGINT AS supply, sum(supply)::BIGINT * {epochs} AS capacity,
      {_weights(path)} AS w FROM leaf GROUP BY {cols}),
  rk{depth} AS (SELECT n.*, p.budget, capacity::DOUBLE / w AS fill FROM nd{depth} n JOIN lv{depth - 1} p ON {on}),
  fl{depth} AS (SELECT *, capacity::DOUBLE * (sum(w) OVER {whole} - coalesce(sum(w) OVER {upto}, 0))::DOUBLE
      <= (budget - coalesce(sum(capacity) OVER {upto}, 0))::DOUBLE * w AS is_full FROM rk{depth}),
  lv{depth} AS (SELECT {cols}, supply, CASE WHEN is_full THEN capacity ELSE least(capacity, floor(
      (budget - coalesce(sum(capacity) FILTER (is_full) OVER {whole}, 0))::DOUBLE * w
      / (sum(w) FILTER (NOT is_full) OVER {whole})::DOUBLE)) END::BIGINT AS budget FROM fl{depth})"""
        )
    ctes.append(
        f"""keyed AS (SELECT m.*, e.epoch::INT AS epoch, l.budget AS leaf_budget, l.supply,
      md5('{seed}|' || e.epoch || '|' || coalesce(doc_id::VARCHAR, '')) AS k
    FROM mixed m JOIN lv3 l ON m.domain = l.domain AND m.lang IS NOT DISTINCT FROM l.lang
      AND m.source IS NOT DISTINCT FROM l.source, range(1, {epochs + 1}) e(epoch)),
  cum AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY k, doc_id, n_tokens
      ROWS UNBOUNDED PRECEDING)::BIGINT AS cum_tokens FROM keyed),
  picked AS (SELECT * FROM cum WHERE leaf_budget - supply * (epoch - 1) > 0
      AND cum_tokens <= leaf_budget - supply * (epoch - 1))"""
    )
    return ",\n  ".join(ctes)


MIX = f"""
WITH {mix_ctes(mixing.SHARE, mixing.EPOCHS, mixing.SEED)}
SELECT doc_id, domain, lang, source, n_tokens, epoch, cum_tokens, leaf_budget FROM picked
"""

# Bytes as hex digits: windows of 200 bytes that start at two places or more, and what they cover.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS n FROM documents),
  w AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, 400)) AS k
    FROM d, LATERAL (SELECT unnest(range(0, n - 199)) AS p)),
  dup AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
  st AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 200, true) AS fresh
    FROM w SEMI JOIN dup USING (k)),
  g AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM st),
  spans AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY doc_id, run),
  kept AS (
    SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z, b, h
    FROM spans JOIN d USING (doc_id)),
  cut AS (
    SELECT doc_id, any_value(h) AS h, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
      string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) AS parts
    FROM kept GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(parts || substr(d.h, 2 * last + 1), d.h))) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""

_SPACED = "regexp_extract_all(coalesce({text}, ''), '[^\\x20\\x09-\\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH d AS (SELECT doc_id, {_SPACED.format(text="text")} AS w FROM documents),
  win AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 19], ' ')) AS k
    FROM d, LATERAL (SELECT unnest(range(1, len(w) - 18)) AS p)),
  late AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
  gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS x FROM late),
  words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS x FROM d),
  kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY x) AS t FROM words ANTI JOIN gone USING (doc_id, x) GROUP BY doc_id),
  n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(c, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

NEAR_DEDUP = f"""
WITH RECURSIVE d AS (
    SELECT doc_id, {_SPACED.format(text=f"translate(text, '{_UP}', '{_LOW}')")} AS w FROM documents),
  sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM d WHERE len(w) > 0),
  n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
  df AS (SELECT s, count(*) AS c FROM sh GROUP BY s),
  rare AS (SELECT doc_id, s, n FROM sh JOIN df USING (s) JOIN n USING (doc_id)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY c, s) <= n - (n * 80 + 99) // 100 + 1),
  cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb FROM rare a JOIN rare b
    ON a.s = b.s AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
  link AS (SELECT a, b FROM cand JOIN sh x ON x.doc_id = a JOIN sh y ON y.doc_id = b AND x.s = y.s
    GROUP BY a, b, na, nb HAVING 100 * count(*) >= 80 * (na + nb - count(*))),
  two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
  reach AS (SELECT doc_id, doc_id AS r FROM d UNION SELECT reach.doc_id, two.b FROM reach JOIN two ON two.a = reach.r),
  comp AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""

# SHA-1 in base 32: five hex digits are four letters.
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_BASE32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('"
    + _LETTERS
    + "', ((('0x' || substr(sha1({x}), 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '')"
)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
  f AS (SELECT page_id, h, min(page_id) OVER (PARTITION BY h) AS origin FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, {_BASE32.format(x="h")} AS payload_digest,
  CASE WHEN origin = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN origin != page_id THEN origin END AS refers_to, true AS valid
FROM f
"""

# Failed filters as a set of letters; a step removes who fails its letter and none before it.
FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_SPACED.format(text="text")} AS w FROM documents),
  first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
  f AS (SELECT part, doc_id,
      (CASE WHEN len(w) < 200 THEN 'A' ELSE '' END)
      || (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END)
      || (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END)
      || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
      || (CASE WHEN doc_id > least THEN 'E' ELSE '' END) AS fails
    FROM d JOIN first USING (t)),
  g AS (SELECT part, fails, count(*) AS n,
      count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good,
      count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) AS toxic
    FROM f GROUP BY ALL),
  l(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
  o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e
    WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
  s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS prior
    FROM o, range(1, 6) r(step)),
  m AS (SELECT part, filter_order, step, own, n, good, toxic, contains(fails, own) AS hit, fails = own AS alone,
      fails != '' AND prior != '' AND regexp_matches(fails, '[' || CASE prior WHEN '' THEN '-' ELSE prior END || ']') AS before
    FROM g, s),
  c AS (SELECT part, filter_order, step, own,
      coalesce(sum(n) FILTER (NOT before AND NOT hit), 0)::BIGINT AS kept,
      coalesce(sum(n) FILTER (NOT before AND hit), 0)::BIGINT AS removed,
      coalesce(sum(n) FILTER (before AND hit), 0)::BIGINT AS redundant,
      coalesce(sum(n) FILTER (alone), 0)::BIGINT AS unique_fails,
      coalesce(sum(good) FILTER (NOT before AND hit), 0)::BIGINT AS good_lost,
      coalesce(sum(toxic) FILTER (NOT before AND hit), 0)::BIGINT AS toxic_lost
    FROM m GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM c
"""

ORACLE = {
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op2_decontaminate": DECONTAMINATE,
    "op3_shard": SHARD,
    "op5_near_dedup": NEAR_DEDUP,
    "op6_mix": MIX,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op9_warc": WARC,
    "op13_filter_audit": FILTER_AUDIT,
}
