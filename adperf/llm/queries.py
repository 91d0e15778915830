"""Registered queries of this package and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpus_pipeline import run as pipeline

from . import (
    decontaminate,
    exact_dedup,
    language,
    line_dedup,
    merkle,
    near_dedup,
    packing,
    repair,
    sharding,
    substring_dedup,
    suffix_dedup,
    token_counts,
    toxicity,
)
from .tables import table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at Jaccard 0.85 on three-word shingles."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated line runs of every document and the lines deleted."""
    return line_dedup.report(table(spark, sf_dir, "documents")).drop("depth", "runs")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the held-out fifth."""
    return language.report(table(spark, sf_dir, "documents"), folds=5, fold=0)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of ten words in every document."""
    return decontaminate.report(table(spark, sf_dir, "documents"),
                                table(spark, sf_dir, "benchmark"), window=10)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by jump consistent hashing of the id (law ``key``)."""
    return sharding.assign(table(spark, sf_dir, "documents"), shards=24)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat a 50-byte string of a smaller doc_id."""
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of 2048 words with all pieces of all documents."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts: the row with the largest doc_id stays."""
    return exact_dedup.dedup(exact_dedup.digests(table(spark, sf_dir, "documents")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned outside the held-out third."""
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of every document, by sliding spans of sentences."""
    return substring_dedup.report(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage, faults and the cheapest repair of every conversation."""
    return repair.report(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proof of every document, a third of which has its capitals lowered meanwhile."""
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.tampered_third())


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text by the 50k byte-level BPE, against a context of 1,024."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op3_language": op3_language,
    "op4_decontaminate": op4_decontaminate,
    "op5_sharding": op5_sharding,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_counts": op13_token_counts,
    "pipeline": pipeline,
}

SQL: dict[str, str] = {
    # capitals outside A-Z stay as they are: translate(), not lower()
    "op1_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 2), ' ') AS shingle
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d
                    WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
                   FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
                   GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN n AS na ON a = na.doc_id
                  JOIN n AS nb ON b = nb.doc_id
                  WHERE 100 * c >= 85 * (na.n + nb.n - c)),
        reach(doc_id, other) AS (
            SELECT doc_id, doc_id FROM documents
            UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id,
               d.doc_id = c.component_id AS kept
        FROM d LEFT JOIN n USING (doc_id)
        JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c
            USING (doc_id)
    """,
    "op4_decontaminate": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
                     translate(coalesce(text, ''),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
               FROM (SELECT item_id, w, least(10, len(w)) AS n,
                            unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b
                     WHERE len(w) > 0)),
        dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
               FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                     FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
        hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.s = bw.s),
        pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(*) AS n_items,
                      string_agg(item_id, ',' ORDER BY item_id) AS items
               FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    """,
    # runs from two lines on, or one line of 40 characters: what longer runs cover, the pairs
    # inside them cover too
    "op2_line_dedup": r"""
        WITH l AS (SELECT doc_id, pos, rtrim(line, ' ') AS line FROM (
                     SELECT doc_id, generate_subscripts(x, 1) - 1 AS pos, unnest(x) AS line
                     FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x
                           FROM documents)) WHERE rtrim(line, ' ') <> ''),
        s AS (SELECT doc_id, pos, line, lead(line) OVER w AS line2, lead(pos) OVER w AS pos2
              FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
        runs AS (SELECT doc_id, pos AS lo, pos AS hi, row_number() OVER
                        (PARTITION BY line ORDER BY doc_id, pos) AS nth
                 FROM s WHERE length(line) >= 40
                 UNION ALL
                 SELECT doc_id, pos, pos2, row_number() OVER
                        (PARTITION BY line, line2 ORDER BY doc_id, pos)
                 FROM s WHERE line2 IS NOT NULL),
        gone AS (SELECT DISTINCT doc_id, unnest(range(lo, hi + 1)) AS pos
                 FROM runs WHERE nth > 1),
        marked AS (SELECT doc_id, pos, CASE WHEN lag(pos) OVER
                     (PARTITION BY doc_id ORDER BY pos) = pos - 1 THEN 0 ELSE 1 END AS new
                   FROM gone),
        per AS (SELECT doc_id, count(*) AS n_deleted, sum(new) AS n_runs
                FROM marked GROUP BY doc_id),
        n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines,
               CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
               coalesce(n_deleted, 0) AS n_deleted
        FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN per USING (doc_id)
    """,
    # list_reduce gives the CRC-32 of the decimal id, bit by bit
    "op12_merkle_manifest": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, text,
                   coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-')
                   || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-')
                   || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
                   4294967295 - list_reduce(list_prepend(4294967295,
                       list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                           lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS crc
            FROM documents),
        leaf AS (
            SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf FROM d),
        placed AS (
            SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree,
                   row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
                   count(*) OVER (PARTITION BY lang) AS n
            FROM leaf),
        up(tree, level, idx, n, hash) AS (
            SELECT tree, 0, idx, n, leaf FROM placed
            UNION ALL
            SELECT tree, level + 1, idx // 8, (any_value(n) + 7) // 8,
                   sha256(string_agg(hash, '' ORDER BY idx))
            FROM up WHERE n > 1 GROUP BY tree, level, idx // 8),
        top(level, idx, n, hash) AS (
            SELECT 0, tree, count(*) OVER (), hash FROM up WHERE n = 1
            UNION ALL
            SELECT level + 1, idx // 8, (any_value(n) + 7) // 8,
                   sha256(string_agg(hash, '' ORDER BY idx))
            FROM top WHERE n > 1 GROUP BY level, idx // 8),
        climb(tree, leaf_at, stage, level, idx, n, proof, folded) AS (
            SELECT tree, idx, 0, 0, idx, n, '',
                   CASE WHEN crc % 3 = 0 THEN sha256(head || coalesce(strlen(text) || ':' ||
                        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-'))
                        ELSE leaf END
            FROM placed
            UNION ALL
            SELECT c.tree, c.leaf_at, c.stage, c.level + 1, c.idx // 8, (c.n + 7) // 8,
                   c.proof || coalesce(string_agg(u.hash, '' ORDER BY u.idx) FILTER (u.idx <> c.idx), ''),
                   sha256(string_agg(CASE WHEN u.idx = c.idx THEN c.folded ELSE u.hash END, ''
                                     ORDER BY u.idx))
            FROM climb c JOIN up u ON u.tree = c.tree AND u.level = c.level AND u.idx // 8 = c.idx // 8
            WHERE c.n > 1 AND c.stage = 0
            GROUP BY c.tree, c.leaf_at, c.stage, c.level, c.idx, c.n, c.proof, c.folded),
        crown(tree, leaf_at, level, idx, n, proof, folded) AS (
            SELECT c.tree, c.leaf_at, 0, c.tree, (SELECT count(*) FROM up WHERE n = 1), c.proof, c.folded
            FROM climb c WHERE c.n = 1
            UNION ALL
            SELECT c.tree, c.leaf_at, c.level + 1, c.idx // 8, (c.n + 7) // 8,
                   c.proof || coalesce(string_agg(u.hash, '' ORDER BY u.idx) FILTER (u.idx <> c.idx), ''),
                   sha256(string_agg(CASE WHEN u.idx = c.idx THEN c.folded ELSE u.hash END, ''
                                     ORDER BY u.idx))
            FROM crown c JOIN top u ON u.level = c.level AND u.idx // 8 = c.idx // 8
            WHERE c.n > 1
            GROUP BY c.tree, c.leaf_at, c.level, c.idx, c.n, c.proof, c.folded)
        SELECT p.doc_id, p.leaf, s.hash AS subroot, r.hash AS root, sha256(c.proof) AS proof_sha256,
               c.folded AS folded_root, c.folded = r.hash AS verified
        FROM placed p JOIN crown c ON c.tree = p.tree AND c.leaf_at = p.idx AND c.n = 1
        JOIN up s ON s.tree = p.tree AND s.n = 1 JOIN top r ON r.n = 1
    """,
    # a table over (row, state) gives the least (cost, audit); two inserts reach every state
    "op11_conversation_repair": r"""
        WITH RECURSIVE k AS (
            SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')
                      AS key FROM conversations),
        c AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   (4294967295 - list_reduce(list_prepend(4294967295,
                       list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0],
                           lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) % 20 AS kind
            FROM k),
        rows AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g')
                        ELSE text END AS text
            FROM c, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
        placed AS (
            SELECT *, row_number() OVER w AS i, left(role, 1) AS initial,
                   left(role, 1) IN ('s', 'u', 'a')
                   AND lag(left(role, 1)) OVER w || left(role, 1) IN ('su', 'ua', 'au') AS fits,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS seen
            FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        marked AS (
            SELECT *, CASE WHEN seen = '' THEN 'b'
                           WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'd'
                           WHEN seen NOT IN ('.', '!', '?') THEN 't' ELSE 'n' END AS fault
            FROM placed),
        steps(q, r, p) AS (VALUES ('B', 's', 'S'), ('B', 'u', 'U'), ('S', 'u', 'U'), ('U', 'a', 'A'),
                                  ('A', 'u', 'U')),
        inserts AS (
            SELECT q, '' AS letters, 0 AS cost, q AS p, CAST([] AS VARCHAR[]) AS turns
            FROM (VALUES ('B'), ('S'), ('U'), ('A')) AS t(q)
            UNION ALL
            SELECT q, 'I', 2, p, [CASE r WHEN 'u' THEN 'user:' ELSE 'assistant:' END]
            FROM steps WHERE r <> 's'
            UNION ALL
            SELECT x.q, 'II', 4, y.p, [CASE x.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END,
                                       CASE y.r WHEN 'u' THEN 'user:' ELSE 'assistant:' END]
            FROM steps x JOIN steps y ON x.p = y.q WHERE x.r <> 's' AND y.r <> 's'),
        edits AS (
            SELECT conv_id, i, 'D' AS letter, 3 AS cost, NULL AS r, CAST([] AS VARCHAR[]) AS turns
            FROM marked
            UNION ALL
            SELECT conv_id, i, 'K', CAST(fault = 't' AS INT), initial, [role || ':' || text]
            FROM marked WHERE fault IN ('n', 't') AND initial IN ('s', 'u', 'a')
            UNION ALL
            SELECT conv_id, i, 'R', 2 + CAST(fault = 't' AS INT), left(new, 1), [new || ':' || text]
            FROM marked, (VALUES ('user'), ('assistant')) AS t(new) WHERE fault IN ('n', 't')),
        best(conv_id, i, q, w) AS (
            SELECT DISTINCT conv_id, CAST(1 AS BIGINT), 'B',
                   {'cost': 0, 'audit': '', 'turns': CAST([] AS VARCHAR[])} FROM conversations
            UNION ALL
            SELECT b.conv_id, b.i + 1, coalesce(s.p, n.p),
                   min({'cost': b.w.cost + n.cost + e.cost, 'audit': b.w.audit || n.letters || e.letter,
                        'turns': b.w.turns || n.turns || e.turns})
            FROM best b JOIN inserts n ON n.q = b.q
            JOIN edits e ON e.conv_id IS NOT DISTINCT FROM b.conv_id AND e.i = b.i
            LEFT JOIN steps s ON s.q = n.p AND s.r = e.r
            WHERE e.letter = 'D' OR s.p IS NOT NULL
            GROUP BY b.conv_id, b.i, coalesce(s.p, n.p)),
        measures AS (
            SELECT conv_id, count(*) AS rows,
                   coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count_if(fault = 'b') AS blank, count_if(fault = 'd') AS duplicate,
                   count_if(fault = 't') AS truncated, count_if(i > 1 AND NOT fits) AS illegal
            FROM marked GROUP BY conv_id),
        ends AS (
            SELECT b.conv_id, min({'cost': b.w.cost + n.cost, 'audit': b.w.audit || n.letters,
                                   'turns': b.w.turns || n.turns}) AS w
            FROM best b JOIN inserts n ON n.q = b.q
            LEFT JOIN measures m ON m.conv_id IS NOT DISTINCT FROM b.conv_id
            WHERE b.i = coalesce(m.rows, 0) + 1 AND n.p IN ('B', 'A') GROUP BY b.conv_id)
        SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps,
               CAST(coalesce(blank, 0) AS BIGINT) AS blank,
               CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
               CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
               CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(e.w.cost AS BIGINT) AS cost,
               e.w.audit AS audit, sha256(array_to_string(e.w.turns, chr(10))) AS repaired_sha256
        FROM ends e LEFT JOIN measures m ON m.conv_id IS NOT DISTINCT FROM e.conv_id
    """,
}
