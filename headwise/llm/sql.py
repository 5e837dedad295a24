"""The queries' SQL for DuckDB, written from their definitions."""

from headwise.llm.urls import SOFT, STRICT

MIX_SQL = """
WITH RECURSIVE
given_docs AS (
    SELECT doc_id, source, coalesce(length(text), 0) AS n,
           CASE WHEN source IN ('src0','src1','src2','src3','src4','src5','src6','src7') THEN source END AS stream,
           md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
streams(i, stream, share) AS (VALUES
    (0, 'src0', 16), (1, 'src1', 9), (2, 'src2', 9), (3, 'src3', 7), (4, 'src4', 7),
    (5, 'src5', 5), (6, 'src6', 5), (7, 'src7', 3), (8, NULL, 39)),
edf(t, given, pick) AS (
    SELECT -1, [0, 0, 0, 0, 0, 0, 0, 0, 0], -1
    UNION ALL
    SELECT t + 1, [given[j + 1] + CASE WHEN j = p THEN 1 ELSE 0 END FOR j IN range(9)], p
    FROM (SELECT t, given, list_min([
              CASE WHEN (given[j + 1] * 100) // [16, 9, 9, 7, 7, 5, 5, 3, 39][j + 1] <= t + 1
                   THEN (((given[j + 1] + 1) * 100 + [16, 9, 9, 7, 7, 5, 5, 3, 39][j + 1] - 1)
                         // [16, 9, 9, 7, 7, 5, 5, 3, 39][j + 1]) * 1000 + j
                   ELSE 1000000000 END FOR j IN range(9)]) % 1000 AS p
          FROM edf WHERE t < 99)),
period AS (
    SELECT pick AS i, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn, t
    FROM edf WHERE t >= 0),
placed AS (
    SELECT d.doc_id, d.source, d.stream, s.i, s.share,
           row_number() OVER w AS source_row,
           CAST(coalesce(sum(n) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 8192 AS block
    FROM given_docs d JOIN streams s ON d.stream IS NOT DISTINCT FROM s.stream
    WINDOW w AS (PARTITION BY s.i ORDER BY d.h, d.doc_id))
SELECT p.doc_id, p.source, p.stream, p.source_row, p.block, (p.block // p.share) * 100 + q.t AS slot
FROM placed p JOIN period q ON q.i = p.i AND q.turn = p.block % p.share
"""


def _terms(terms: tuple[str, ...]) -> str:
    """How many of the terms occur between boundaries."""
    found = [f"CAST(regexp_matches(u, '(^|[^a-z0-9]){t}([^a-z0-9]|$)') AS INTEGER)" for t in terms]
    return " + ".join(found)


URLS_SQL = f"""
WITH parts AS (
    SELECT page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS u,
           coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
           coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
    FROM pages),
hits AS (
    SELECT page_id, host, path, '.' || host AS h, {_terms(STRICT)} AS n_strict, {_terms(SOFT)} AS n_soft
    FROM parts),
ruled AS (
    SELECT *, CASE
        WHEN h LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN h LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN h LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
        WHEN h LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN h LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
    FROM hits)
SELECT page_id, host, path, rule, n_strict, n_soft,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

# Windows are compared by their lines themselves, not by hashes.
LINES_SQL = r"""
WITH doc AS (
    SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
line AS (
    SELECT doc_id, pos, lines[pos + 1] AS one,
           len(regexp_extract_all(lines[pos + 1], '[^\x20\x09-\x0D]+')) AS words
    FROM (SELECT doc_id, lines, unnest(range(len(lines))) AS pos FROM doc)),
summed AS (
    SELECT *, CAST(sum(words) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS upto FROM line WHERE words > 0),
ranged AS (SELECT *, upto - words AS since FROM summed),
spans AS (
    SELECT doc_id, since, upto, pos AS first, max(pos) OVER f AS last, max(upto) OVER f - since AS n, list(one) OVER f AS body
    FROM ranged WINDOW f AS (PARTITION BY doc_id ORDER BY since RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
    UNION ALL
    SELECT doc_id, since, upto, min(pos) OVER b, pos, upto - min(since) OVER b, list(one) OVER b
    FROM ranged WINDOW b AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)),
windows AS (SELECT doc_id, first, last, array_to_string(body, chr(10)) AS body FROM spans WHERE n >= 50),
origin AS (
    SELECT body, min({'d': doc_id, 'first': first, 'last': last}) AS o FROM windows GROUP BY body),
gone AS (
    SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos
    FROM windows JOIN origin USING (body)
    WHERE o.d < doc_id OR (o.d = doc_id AND first > o.last)),
dead AS (SELECT doc_id, list(pos) AS pos FROM gone GROUP BY doc_id)
SELECT doc_id, CASE WHEN dead.pos IS NULL THEN text
           ELSE array_to_string([lines[i + 1] FOR i IN range(len(lines)) IF NOT list_contains(dead.pos, i)], chr(10)) END AS text,
       len(lines) AS n_lines, coalesce(len(dead.pos), 0) AS n_removed
FROM doc LEFT JOIN dead USING (doc_id)
"""

EMBEDDINGS_SQL = """
WITH v AS (
    SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
           CAST(list_sum([q.e[i] * c.e[i] FOR i IN range(1, len(q.e) + 1)]) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""

# Whole texts; terms are joined as text.
LEXICAL_SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, w, len(w) AS n, row_number() OVER () AS d FROM words WHERE len(w) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sized),
posting AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(w) AS term FROM sized) GROUP BY ALL),
weight AS (
    SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM posting, totals GROUP BY term, docs),
asked AS (
    SELECT item_id, term, count(*) AS times FROM (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
        FROM benchmark) GROUP BY ALL),
scored AS (
    SELECT item_id, doc_id, d,
           CAST(sum(times * weight.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
    FROM asked JOIN weight USING (term) JOIN posting USING (term) JOIN sized USING (d), totals GROUP BY item_id, doc_id, d),
ranked AS (
    SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
    FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 20
"""

# The template's lengths follow from its definition: two characters per escaped one.
CHAT_SQL = r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
    SELECT *,
        length(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'))
            + length(role) - length(replace(role, ':', '')) AS role_n,
        length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) AS text_n
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### ') + role_n + length(': ') + text_n + length('</turn>') + 1) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

# CRC-32 by its definition, a byte at a time over a table that is computed first.
IMPORTANCE_SQL = r"""
WITH crc_table AS (
    SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(j AS BIGINT) FOR j IN range(8)]),
                lambda c, j: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS t
    FROM range(256) r(b)),
given AS (
    SELECT 'd' AS side, doc_id, text, row_number() OVER () AS d FROM documents
    UNION ALL SELECT 'b', NULL, text, NULL FROM benchmark),
words AS (
    SELECT side, doc_id, d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM given),
counted AS (SELECT side, d, word, count(*) AS c FROM (SELECT side, d, unnest(w) AS word FROM words) GROUP BY ALL),
bytes AS (
    SELECT word, [CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)
                  FOR i IN range(octet_length(encode(word)))] AS b
    FROM (SELECT DISTINCT word FROM counted)),
bucketed AS (
    SELECT word, xor(list_reduce(list_prepend(4294967295, b),
        lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8)), 4294967295) % 10000 AS bucket
    FROM bytes, crc_table),
features AS (SELECT side, d, bucket, CAST(sum(c) AS BIGINT) AS c FROM counted JOIN bucketed USING (word) GROUP BY ALL),
cells AS (
    SELECT bucket, CAST(coalesce(sum(c) FILTER (side = 'd'), 0) AS BIGINT) AS s,
           CAST(coalesce(sum(c) FILTER (side = 'b'), 0) AS BIGINT) AS t FROM features GROUP BY bucket),
totals AS (SELECT CAST(sum(s) AS BIGINT) AS s_all, CAST(sum(t) AS BIGINT) AS t_all FROM cells),
gains AS (
    SELECT bucket, CAST(floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE
                                        / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE))) AS BIGINT) AS gain
    FROM cells, totals),
weighed AS (SELECT d, CAST(sum(c * gain) AS BIGINT) AS weight FROM features JOIN gains USING (bucket) GROUP BY d),
noised AS (
    SELECT doc_id, d, CAST(len(w) AS BIGINT) AS n_features,
           CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
    FROM words WHERE side = 'd'),
scored AS (
    SELECT doc_id, d, n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
    FROM noised LEFT JOIN weighed USING (d)),
drawn AS (
    SELECT d, row_number() OVER (ORDER BY score DESC, doc_id) AS place, 10 * count(*) OVER () // 100 AS most
    FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank
FROM scored LEFT JOIN drawn USING (d)
"""
