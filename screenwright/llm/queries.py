"""The registered queries of this subpackage, each over its whole table, and SQL giving the same rows where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (classifier, decontamination, manifest, mixing, pii, quality, scoring, secrets, simhash, substrings, tokens,
               whitening, wrappers)
from .common import tables


def _documents(operator):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return operator.digest(tables(spark, sf_dir, "documents"))

    return query


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "benchmark"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.digest(tables(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(tables(spark, sf_dir, "embeddings"))


def op13_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.digest(tables(spark, sf_dir, "documents"), tables(spark, sf_dir, "labels"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_secrets": _documents(secrets),
    "op3_quality": _documents(quality),
    "op4_personal_data": _documents(pii),
    "op5_repeated_passages": _documents(substrings),
    "op6_token_counts": _documents(tokens),
    "op7_lm_scores": _documents(scoring),
    "op8_near_duplicates": _documents(simhash),
    "op9_mixing": _documents(mixing),
    "op10_main_text": op10_main_text,
    "op11_manifest": _documents(manifest),
    "op12_whitening": op12_whitening,
    "op13_quality_scores": op13_quality_scores,
}

# Words and windows, then windows of documents of the lengths that items have; a hit window marks its words.
_OP1 = r"""
WITH items AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS window
    FROM items, range(1, greatest(len(w) - 12, 1) + 1) r(i) WHERE len(w) > 0),
docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents),
found AS (
    SELECT d.doc_id, r.i, l.n, v.item_id
    FROM docs d, (SELECT DISTINCT n FROM windows) l, range(1, len(d.w) - l.n + 2) r(i)
    JOIN windows v ON v.n = l.n AND v.window = array_to_string(d.w[r.i:r.i + l.n - 1], ' ')),
hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
owners AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items,
       sha256(coalesce(o.ids, '')) AS items_sha256,
       coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hit h USING (doc_id) LEFT JOIN owners o USING (doc_id)
"""

_OP5 = r"""
WITH docs AS (
    SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
windows AS (
    SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS words FROM docs, range(1, len(w) - 18) r(i)),
later AS (
    SELECT doc_id, i FROM (
        SELECT doc_id, i, row_number() OVER (PARTITION BY words ORDER BY doc_id, i) AS place FROM windows)
    WHERE place > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM later),
lost AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
    SELECT d.doc_id, string_agg(d.w[p.i], ' ' ORDER BY p.i) AS text
    FROM docs d, range(1, len(d.w) + 1) p(i)
    LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.p = p.i WHERE g.p IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(l.n, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM docs d LEFT JOIN lost l USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

# Sharing again until no source is above its cap: the level is the smallest at which the sources below it take the rest.
_OP9 = r"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
sources AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
           [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
    FROM docs GROUP BY source),
stops AS (
    SELECT *, sum(2 * source_size) OVER o - 2 * source_size AS stopped, sum(weight) OVER o - weight AS gone,
           sum(source_size) OVER () AS everything, sum(weight) OVER () AS weights
    FROM sources
    WINDOW o AS (ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source ROWS UNBOUNDED PRECEDING)),
level AS (
    SELECT (3 * everything - 2 * stopped) / CAST(2 * (weights - gone) AS DOUBLE) AS level FROM stops
    WHERE weight * ((3 * everything - 2 * stopped) / CAST(2 * (weights - gone) AS DOUBLE)) <= 2 * source_size
    ORDER BY 2 * source_size / CAST(weight AS DOUBLE), source LIMIT 1),
targets AS (
    SELECT source, source_size, least(weight * coalesce(level, 0), CAST(2 * source_size AS DOUBLE)) AS target
    FROM sources, level),
placed AS (
    SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
           CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
           row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) - 1 AS place,
           CAST(('0x' || substr(md5(coalesce('s' || d.source, 'null')), 1, 8)) AS BIGINT) / 4294967296.0 AS start
    FROM docs d JOIN targets t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, source,
       size * CAST(floor(rate * (place + 1) + start) - floor(rate * place + start) AS BIGINT) AS taken
FROM placed
"""

# Levels from below; a path is a list of steps, folded from the leaf on. CRC-32 is worked out bit by bit.
_OP11 = r"""
WITH RECURSIVE fields AS (
    SELECT doc_id, lang, n_chars,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(text) || ':' || text, '-') AS tail,
           list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
               lambda crc, byte: list_reduce([xor(crc, byte), 1, 2, 3, 4, 5, 6, 7, 8], lambda x, i:
                   CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)) AS crc
    FROM documents),
leaves AS (
    SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
           CASE WHEN xor(crc, 4294967295) % 7 = 0
                THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS claimed
    FROM fields),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS n
    FROM leaves),
nodes(lang, level, place, n, d) AS (
    SELECT lang, 0, place, n, leaf FROM ranked
    UNION ALL
    SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(d, '' ORDER BY place))
    FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n),
subroots AS (
    SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot, count(*) OVER () AS m FROM nodes WHERE n = 1),
tops(level, place, m, d) AS (
    SELECT 0, spot, m, subroot FROM subroots
    UNION ALL
    SELECT level + 1, place // 2, (m + 1) // 2, sha256(string_agg(d, '' ORDER BY place)) FROM tops WHERE m > 1 GROUP BY level, place // 2, m),
steps AS (
    SELECT r.lang, r.place, n.level AS step, coalesce(CASE WHEN s.place < n.place THEN 'L' ELSE 'R' END || s.d, 'N') AS move
    FROM ranked r JOIN nodes n ON n.lang IS NOT DISTINCT FROM r.lang AND n.place = r.place >> n.level AND n.n > 1
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM n.lang AND s.level = n.level AND s.place = xor(n.place, 1)
    UNION ALL
    SELECT r.lang, r.place, 1000 + n.level, coalesce(CASE WHEN s.place < n.place THEN 'L' ELSE 'R' END || s.d, 'N')
    FROM ranked r JOIN subroots b ON b.lang IS NOT DISTINCT FROM r.lang JOIN tops n ON n.place = b.spot >> n.level AND n.m > 1
    LEFT JOIN tops s ON s.level = n.level AND s.place = xor(n.place, 1)),
paths AS (SELECT lang, place, list(move ORDER BY step) AS moves FROM steps GROUP BY lang, place),
proved AS (
    SELECT r.doc_id, r.leaf, b.subroot, (SELECT d FROM tops WHERE m = 1) AS root,
           sha256(array_to_string(list_transform(coalesce(p.moves, []), lambda x: substr(x, 2)), '')) AS proof_sha256,
           list_reduce(list_prepend(coalesce(r.claimed, r.leaf), coalesce(p.moves, [])), lambda a, x: sha256(
               CASE x[1] WHEN 'L' THEN substr(x, 2) || a WHEN 'R' THEN a || substr(x, 2) ELSE a END)) AS folded_root
    FROM ranked r JOIN subroots b ON b.lang IS NOT DISTINCT FROM r.lang
    LEFT JOIN paths p ON p.lang IS NOT DISTINCT FROM r.lang AND p.place = r.place)
SELECT *, folded_root = root AS verified FROM proved
"""

ORACLE = {"op11_manifest": _OP11, "op1_decontamination": _OP1, "op5_repeated_passages": _OP5, "op9_mixing": _OP9}
