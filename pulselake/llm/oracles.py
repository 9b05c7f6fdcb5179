"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP4 = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce("text", ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS line FROM parts),
keyed AS (SELECT doc_id, i, line, translate(trim(line, {_SPACES}), '{_UP}', '{_LOW}') AS k FROM lines),
firsts AS (SELECT k, min(doc_id) AS first_id FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (SELECT doc_id, i, line, coalesce(doc_id > first_id, false) AS gone FROM keyed LEFT JOIN firsts USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _seats(parties: str, group: str, party: str) -> str:
    """Highest-quotient seats by the plain method: every seat of every party stands in line."""
    by = f"PARTITION BY {group} " if group else ""
    to = f"{group}, {party}" if group else party
    return f"""(SELECT {to}, count(*) AS quota FROM (
        SELECT *, row_number() OVER ({by}ORDER BY votes / (2.0 * seat + 1.0) DESC, {party} NULLS LAST, seat) AS place
        FROM (SELECT *, unnest(range(most)) AS seat FROM {parties})) WHERE place <= seats GROUP BY {to})"""


def _hex(digest: str, at: int) -> str:
    return f"CAST('0x' || substr({digest}, {at}, 7) AS BIGINT)"


OP9 = f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len({_WORDS.format('"text"')}), 0) AS BIGINT) AS size,
                      md5('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(sum(source_size) OVER () AS BIGINT) AS total, count(*) OVER () AS n_sources, source_size * 2.0 AS cap,
                   CAST([5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM totals),
lined AS (SELECT *, cap / weight AS ratio,
                 (total * CAST(1.5 AS DOUBLE) - coalesce(sum(CAST(cap AS DOUBLE)) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
water AS (SELECT *, (SELECT level FROM lined WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) AS water FROM lined),
aimed AS (SELECT *, CAST(CASE WHEN water IS NULL OR ratio <= water THEN cap ELSE water * weight END AS DOUBLE) AS target,
                 1 + CASE WHEN total > 0 THEN CAST(floor(least(4096, greatest(32, total // 131072)) * source_size / total) AS BIGINT) ELSE 0 END AS n_shards FROM water),
cut AS (SELECT *, greatest(1, least(256, CAST(floor(total / (1000.0 * n_sources)) AS BIGINT), CAST(floor(min(CASE WHEN target > 0 THEN target END) OVER ()) AS BIGINT))) AS block FROM aimed),
parties AS (SELECT *, target AS votes, ceil(total * CAST(1.5 AS DOUBLE) / block) AS seats, CAST(ceil(2.0 * source_size / block) AS BIGINT) AS most FROM cut),
quotas AS (SELECT p.*, coalesce(q.quota, 0) AS quota FROM parties p LEFT JOIN {_seats("parties", "", "source")} q ON p.source IS NOT DISTINCT FROM q.source),
placed AS (SELECT d.*, source_size, target, block, quota, {_hex("digest", 1)} % n_shards AS shard FROM sized d JOIN quotas q ON d.source IS NOT DISTINCT FROM q.source),
shards AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, any_value(block) AS block, any_value(quota) AS seats,
                  CAST(sum(size) AS DOUBLE) AS votes, CAST(ceil(2.0 * sum(size) / any_value(block)) AS BIGINT) AS most FROM placed GROUP BY source, shard),
runs AS (SELECT s.source, s.shard, s.words, least(coalesce(q.quota, 0) * s.block, 2 * s.words) AS run,
                {_hex("md5('7:' || coalesce(s.source, 'null') || ':' || s.shard)", 8)} % greatest(s.words, 1) AS start
         FROM shards s LEFT JOIN {_seats("shards", "source", "shard")} q ON s.source IS NOT DISTINCT FROM q.source AND s.shard = q.shard),
stood AS (SELECT p.doc_id, p.size, p.source_size, p.target, r.words, r.run,
                 CASE WHEN r.words > 0 THEN (CAST(sum(p.size) OVER (PARTITION BY p.source, p.shard ORDER BY p.digest, p.doc_id, p.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - p.size - r.start + r.words) % r.words ELSE 0 END AS pos
          FROM placed p JOIN runs r ON p.source IS NOT DISTINCT FROM r.source AND p.shard = r.shard)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(pos - words + size, run) - greatest(pos - words, 0)) + greatest(0, least(pos + size, run) - greatest(pos, 0))
          + greatest(0, least(pos + words + size, run) - greatest(pos + words, 0)) AS BIGINT) AS taken
FROM stood
"""

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), " + r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8 = f"""
WITH items AS (SELECT item_id, w, len(w) AS n, least(len(w), 13) AS k FROM (SELECT item_id, {_TERMS} AS w FROM benchmark) WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, k, array_to_string(w[o + 1 : o + k], ' ') AS win FROM (SELECT *, unnest(range(n - k + 1)) AS o FROM items)),
docs AS (SELECT doc_id, {_TERMS} AS w FROM documents),
sizes AS (SELECT DISTINCT k FROM wins),
places AS (SELECT doc_id, k, p, array_to_string(w[p + 1 : p + k], ' ') AS win
       FROM (SELECT doc_id, k, w, unnest(range(len(w) - k + 1)) AS p FROM docs, sizes WHERE len(w) >= k)),
met AS (SELECT DISTINCT doc_id, k, p, item_id FROM places JOIN wins USING (k, win)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS x FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP1 = f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
wins AS (SELECT doc_id, p, md5(array_to_string(w[p + 1 : p + 13], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(len(w) - 12)) AS p FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT h, min(doc_id) AS first_id FROM wins GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) + 1 AS i FROM wins JOIN firsts USING (h) WHERE doc_id > first_id),
words AS (SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM docs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT * FROM words ANTI JOIN gone USING (doc_id, i)) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""

OP6 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id < top THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < top THEN top END AS refers_to
FROM p LEFT JOIN m USING (payload_digest)
"""

OP7 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
