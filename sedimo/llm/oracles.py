"""DuckDB SQL for the queries that SQL can express."""

TOPK = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(round(list_inner_product(q.e, c.e)) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER best AS INT) AS rank, vec_id, score
FROM s
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 20
"""

SUBSTRINGS = r"""
WITH w AS (
    SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
    FROM documents
), g AS (
    SELECT doc_id, s, md5(array_to_string(words[s + 1 : s + 20], ' ')) AS gram
    FROM (SELECT doc_id, words, unnest(range(len(words) - 19)) AS s FROM w WHERE len(words) >= 20)
), repeated AS (
    SELECT doc_id, s FROM g
    QUALIFY row_number() OVER (PARTITION BY gram ORDER BY doc_id, s) > 1
), covered AS (
    SELECT DISTINCT doc_id, s + i + 1 AS pos FROM repeated, (SELECT unnest(range(20)) AS i)
), each AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w
), kept AS (
    SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text
    FROM each ANTI JOIN covered USING (doc_id, pos)
    GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

LINES = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), k AS (
    SELECT r, line, i,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT r, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM d)
), frequent AS (
    SELECT key FROM (SELECT DISTINCT r, key FROM k WHERE key <> '') GROUP BY key HAVING count(*) >= 10
), kept AS (
    SELECT r, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS text FROM k ANTI JOIN frequent USING (key) GROUP BY r
)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

MIXING = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
           md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS turn
    FROM documents
), s AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs,
           row_number() OVER (ORDER BY source NULLS LAST) - 1 AS position
    FROM d GROUP BY source
), capped AS (
    SELECT *, 3 * source_size AS cap, 3.0::DOUBLE * source_size / weight AS ratio
    FROM (SELECT *, CAST([5, 2, 1][(position % 3)::INT + 1] AS BIGINT) AS weight FROM s)
), levels AS (
    SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY ratio, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / CAST(sum(weight) OVER (ORDER BY ratio, position ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
    FROM capped
), targets AS (
    SELECT source, position, source_size, n_docs, greatest(1, ceil(n_docs / 4096.0))::BIGINT AS shards,
           coalesce(least(weight * (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, position LIMIT 1), cap::DOUBLE), cap::DOUBLE) AS target
    FROM levels
), total AS (
    SELECT *, words // block AS seats
    FROM (SELECT words, greatest(1, least(2048, words // 1000000)) AS block FROM (SELECT CAST(sum(source_size) AS BIGINT) AS words FROM s))
), blocks AS (
    SELECT position, count(*) FILTER (turn <= seats) AS blocks
    FROM (
        SELECT position, seats, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, position, k) AS turn
        FROM (SELECT position, target, seats, unnest(range((2 + target / block)::BIGINT + (SELECT count(*) FROM s))) AS k FROM targets, total)
        WHERE target > 0
    )
    GROUP BY position
), keyed AS (
    SELECT d.*, t.position, ('0x' || substr(turn, 1, 8))::BIGINT % shards AS shard
    FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), parts AS (
    SELECT position, shard, CAST(sum(size) AS BIGINT) AS shard_size FROM keyed GROUP BY ALL
), quotas AS (
    SELECT position, shard, count(*) FILTER (turn <= blocks) AS quota
    FROM (
        SELECT position, shard, blocks,
               row_number() OVER (PARTITION BY position ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS turn
        FROM (SELECT *, unnest(range(blocks + 1)) AS k FROM parts JOIN blocks USING (position))
        WHERE shard_size > 0
    )
    GROUP BY position, shard
), words AS (
    SELECT position, shard, shard_size, least(coalesce(quota, 0) * block, 3 * shard_size) AS words
    FROM parts LEFT JOIN quotas USING (position, shard), total
), runs AS (
    SELECT k.*, shard_size, words,
           CAST(sum(size) OVER (PARTITION BY position, shard ORDER BY turn, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end",
           CASE WHEN shard_size > 0 THEN words // shard_size ELSE 0 END AS rounds
    FROM keyed k JOIN words USING (position, shard)
)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + least("end", words - rounds * shard_size) - least("end" - size, words - rounds * shard_size) AS BIGINT) AS taken
FROM runs JOIN (SELECT position, source_size, target FROM targets) USING (position)
"""

SQL = {"op2_topk": TOPK, "op3_substrings": SUBSTRINGS, "op6_lines": LINES, "op7_mixing": MIXING}
