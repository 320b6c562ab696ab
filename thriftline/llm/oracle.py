"""DuckDB SQL for the queries that SQL can express."""
from __future__ import annotations

from . import license_dice, link_trust

SPACE = r"[\x20\x09-\x0D]"

#: op1: SHA-1 as hexadecimal digits, these as bits, every five of them as a letter; the largest page of a payload is the response.
OP1 = """
WITH hashed AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(hex, i, 1))::INT), 4, '0')), '') AS b
         FROM hashed),
spelled AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
              + 16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
              + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT, 1)), '') AS payload_digest FROM bits),
first AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS response FROM spelled)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM first
"""

#: op10: keys by two regular expressions and a translation, first holders by a grouping, then the rest joined again.
OP10 = rf"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM docs),
keys AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^{SPACE}+', ''), '{SPACE}+$', ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
shared AS (SELECT key, min(doc_id) AS keeper FROM keys WHERE length(key) >= 10
           GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, pos, line, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM keys LEFT JOIN shared USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: op6: words and windows as rows; a word is covered by the windows that start at it or at the two before it.
OP6 = rf"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM texts),
words AS (SELECT doc_id, unnest(range(len(words))) AS pos, unnest(words) AS word FROM split),
windows AS (SELECT doc_id, pos, word, lead(word) OVER w AS second, lead(word, 2) OVER w AS third
            FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
twice AS (SELECT *, third IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, word, second, third) > 1 AS again FROM windows),
covered AS (SELECT doc_id, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS 2 PRECEDING) AS repeated, length(word) AS chars
            FROM twice),
per_word AS (SELECT doc_id, count(*) AS n_words, sum(chars) AS word_chars, count(*) FILTER (repeated) AS n_repeat_words
             FROM covered GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts),
per_line AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
             FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counted AS (
  SELECT t.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0) AS n_lines, length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) AS n_upper
  FROM texts t LEFT JOIN per_word USING (doc_id) LEFT JOIN per_line USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 3 * n_words OR word_chars > 10 * n_words
            OR 2 * n_dup_lines > n_lines OR 2 * n_upper > word_chars) AS kept
FROM judged
"""


def op2_sql(damping: float = 0.85, rounds: int = 20) -> str:
    """The rules as one CASE, and the power iteration as a chain of ``rounds`` steps in each direction."""
    rules = sorted(link_trust.RULES, key=lambda r: -len(r.name))
    cases = lambda shown: " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{shown(r)}'"
        for r in rules)
    host = lambda url: (
        f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), "
        "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    link = link_trust.LINK.replace("'", "''")
    steps = []
    for side, seed, edges in (("t", "trusted", "edges"), ("d", "blocked", "back")):
        steps.append(f"{side}0 AS (SELECT host, {1 - damping!r}::DOUBLE * {seed} AS score FROM seeds)")
        for k in range(1, rounds + 1):
            steps.append(
                f"{side}{k} AS MATERIALIZED (SELECT host, sum(score) AS score FROM (SELECT host, score FROM {side}0 UNION ALL "
                f"SELECT dst, {damping!r}::DOUBLE * share * score FROM {side}{k - 1} JOIN {edges} ON src = host) GROUP BY host)")
    return f"""
WITH urls AS (SELECT page_id, html, {host('url')} AS host,
                     regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
ruled AS (SELECT *, CASE {cases(lambda r: r.name)} END AS rule, CASE {cases(lambda r: r.verdict)} END AS said FROM urls),
hrefs AS (SELECT host AS src, unnest(regexp_extract_all(html, '{link}', 1)) AS href FROM urls),
linked AS (SELECT src, {host("CASE WHEN starts_with(href, '//') THEN 'http:' || href ELSE href END")} AS dst FROM hrefs),
counted AS (SELECT src, dst, count(*) AS n FROM linked WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
edges AS (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM counted),
back AS (SELECT dst AS src, src AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY dst) AS share FROM counted),
seeds AS (SELECT host, avg((said = 'allow')::INT) AS trusted, avg((said = 'block')::INT) AS blocked
          FROM ruled WHERE said IS NOT NULL AND host <> '' GROUP BY host),
{", ".join(steps)}
SELECT page_id, r.host, path, rule,
       coalesce(said, CASE WHEN coalesce(d.score, 0) - coalesce(t.score, 0) > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled r LEFT JOIN t{rounds} t ON t.host = r.host LEFT JOIN d{rounds} d ON d.host = r.host
"""


def op3_sql(threshold: float = license_dice.THRESHOLD) -> str:
    """Candidates and bigrams as rows, common bigrams counted by a join with the templates' bigrams."""
    rows = []
    for i, (name, text) in enumerate(license_dice.TEMPLATES):
        grams = license_dice.bigrams(text)
        rows += [f"({i}, '{name}', {len(grams)}, '{g}')" for g in grams]
    gaps = r"[^\p{L}\p{N}.]+"
    return rf"""
WITH grams(template, license, size, gram) AS (VALUES {", ".join(rows)}),
units AS (SELECT doc_id, unnest(list_distinct(list_append(string_split(coalesce(text, ''), chr(10)), coalesce(text, '')))) AS unit
          FROM documents),
normal AS (SELECT doc_id, row_number() OVER () AS u, lower(unit) AS unit FROM units),
spaced AS (SELECT doc_id, u, regexp_extract_all(unit, '\p{{N}}+(?:\.\p{{N}}+)+|[\p{{L}}\p{{N}}]+') AS words FROM normal),
own AS (SELECT DISTINCT doc_id, u, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS gram
        FROM spaced),
sizes AS (SELECT u, count(*) AS size FROM own GROUP BY u),
scored AS (SELECT doc_id, u, template, license, 2.0::DOUBLE * count(*) / (any_value(s.size) + any_value(g.size)) AS score
           FROM own JOIN grams g USING (gram) JOIN sizes s USING (u) GROUP BY ALL),
best AS (SELECT doc_id, u, license, score, row_number() OVER (PARTITION BY u ORDER BY score DESC, template) AS place, template
         FROM scored WHERE score >= {threshold}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS first FROM best WHERE place = 1),
found AS (SELECT doc_id, list_sort(list_distinct(list(license))) AS licenses, any_value(license) FILTER (first = 1) AS license,
                 max(score) AS score FROM ranked GROUP BY doc_id)
SELECT d.doc_id, f.license, round(f.score, 6) AS license_score, coalesce(array_to_string(f.licenses, ' '), '') AS licenses
FROM documents d LEFT JOIN found f USING (doc_id)
"""


#: op7: a join of the queries with all rows, whose components are floored one by one.
OP7 = """
WITH ints AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
              WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
           FROM ints q JOIN ints c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op11_sql(k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, dims: int = 64) -> str:
    """Vectors and centroids by component: one pair of steps per round; a centroid that no vector chose keeps its components."""
    steps = [f"""
kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
         WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
parts AS MATERIALIZED (SELECT vec_id, unnest(range({dims})) AS dim, unnest(v) AS x FROM kept),
seeds AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('{seed}:' || vec_id::VARCHAR)) - 1 AS cluster FROM kept),
c0 AS MATERIALIZED (SELECT cluster, dim, x FROM parts JOIN seeds USING (vec_id) WHERE cluster < {k})"""]
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (SELECT vec_id, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
        FROM (SELECT vec_id, cluster, sum((p.x - c.x) * (p.x - c.x)) AS distance FROM parts p JOIN c{i} c USING (dim) GROUP BY ALL) GROUP BY vec_id)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (SELECT cluster, dim, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
         SELECT cluster, dim, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS x
         FROM parts JOIN a{i} USING (vec_id) GROUP BY ALL) m USING (cluster, dim))""")
    return f"""WITH {",".join(steps)},
digests AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY dim)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster::INT AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN digests USING (cluster)
"""


#: op12: the CRC-32 of every distinct word byte by byte, gains per bucket by two countings, then one order of scores.
OP12 = r"""
WITH steps AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: xor(c // 2, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY b) AS crc
               FROM range(256) t(b)),
texts AS (SELECT doc_id, text, FALSE AS target FROM documents UNION ALL SELECT NULL, text, TRUE FROM benchmark),
split AS (SELECT doc_id, target, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM texts),
own AS MATERIALIZED (SELECT doc_id, target, unnest(words) AS word FROM split),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(word), 2), lambda i: ('0x' || substr(hex(word), i, 2))::BIGINT)),
                  lambda c, b: xor(crc[1 + (xor(c, b) & 255)], c >> 8)), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT word FROM own), steps),
placed AS MATERIALIZED (SELECT doc_id, target, bucket FROM own JOIN hashed USING (word)),
counts AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM placed GROUP BY bucket),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain
          FROM counts),
weights AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM placed JOIN gains USING (bucket) WHERE NOT target GROUP BY doc_id),
scored AS (SELECT doc_id, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
                  + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
           FROM split LEFT JOIN weights USING (doc_id) WHERE NOT target),
placed_all AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                      count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed_all
"""

#: op13: texts of equal words once, common shingles by a join, then a walk along the links.
OP13 = rf"""
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                 '[^\x20\x09-\x0D]+') AS words FROM documents),
classes AS MATERIALIZED (SELECT words, min(doc_id) AS first FROM split GROUP BY words),
grams AS MATERIALIZED (SELECT DISTINCT first, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
                     WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS gram FROM classes),
sizes AS MATERIALIZED (SELECT first, count(*) AS n FROM grams GROUP BY first),
common AS (SELECT x.first AS a, y.first AS b, count(*) AS n FROM grams x JOIN grams y USING (gram) WHERE x.first < y.first GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM common c JOIN sizes s ON s.first = a JOIN sizes t ON t.first = b WHERE 100 * c.n >= 85 * (s.n + t.n - c.n)),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reached r JOIN edges e ON e.a = r.b),
component AS (SELECT a AS first, min(b) AS least FROM reached GROUP BY a)
SELECT s.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, CASE WHEN n IS NULL THEN s.doc_id ELSE coalesce(least, c.first) END AS component_id,
       s.doc_id = CASE WHEN n IS NULL THEN s.doc_id ELSE least(coalesce(least, c.first), c.first) END AS kept
FROM split s JOIN classes c USING (words) LEFT JOIN sizes z ON z.first = c.first LEFT JOIN component p ON p.first = c.first
"""


ORACLE_SQL = {
    "op1_warc_bundles": OP1,
    "op7_histogram_topk": OP7, "op2_link_trust": op2_sql(), "op3_license_dice": op3_sql(), "op6_rule_cascade": OP6, "op10_line_dedup": OP10,
    "op11_centroid_clustering": op11_sql(), "op12_importance_resampling": OP12, "op13_setsketch_dedup": OP13,
}
