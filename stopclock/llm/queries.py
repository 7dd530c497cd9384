"""The registered queries of this folder, over whole tables with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stopclock.llm import decontaminate, exact, hardneg, language, licences, lines, mixing, neardup, shards, substrings, tokens, toxicity, trie
from stopclock.llm.shared import output_folder, read_documents


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    return mixing.mix_sources(docs, mixing.tempered(mixing.source_counts(docs)))


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(read_documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(read_documents(spark, sf_dir))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read_documents(spark, sf_dir))


def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(read_documents(spark, sf_dir), licences.document_path())


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_report(read_documents(spark, sf_dir))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_documents(spark, sf_dir))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.training_order(read_documents(spark, sf_dir), output_folder(spark, "tokens"), key=20240229)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine_hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect_toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(trie.branched(trie.turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": op1_near_dedup,
    "op2_mixing": op2_mixing,
    "op3_shards": op3_shards,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_decontaminate": op5_decontaminate,
    "op6_lines": op6_lines,
    "op7_licences": op7_licences,
    "op8_substrings": op8_substrings,
    "op9_language": op9_language,
    "op10_tokens": op10_tokens,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_toxicity": op12_toxicity,
    "op13_conversation_trie": op13_conversation_trie,
}

_TEMPLATE_ROWS = ", ".join(f"('{name}', '{body}')" for name, body in licences.TEMPLATES)
_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda x: x <> ''))"
LICENCE_SQL = rf"""
        WITH templates(name, body) AS (VALUES {_TEMPLATE_ROWS}),
        tt AS (SELECT name, unnest({_TERMS.format("body")}) AS term FROM templates),
        files AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 10 <> 0 OR doc_id // 10 % 3 = 0 THEN source || '/' || (doc_id // 1000) || '/' || (doc_id // 100)
                              WHEN doc_id // 10 % 3 = 1 THEN source || '/' || (doc_id // 1000) ELSE source END AS folder,
                         CASE WHEN doc_id % 10 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END AS file FROM documents),
        df AS (SELECT term, count(*) AS df FROM (SELECT unnest({_TERMS.format("text")}) AS term FROM files) GROUP BY term),
        n AS (SELECT count(*) AS n FROM files),
        w AS (SELECT term, ln((1 + n) / (1.0 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term), n),
        units AS (SELECT name, term, idf / sqrt(sum(idf * idf) OVER (PARTITION BY name)) AS unit FROM tt JOIN w USING (term)),
        lines AS (SELECT DISTINCT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM files)),
        lt AS (SELECT DISTINCT line, unnest({_TERMS.format("line")}) AS term FROM (SELECT DISTINCT line FROM lines)),
        lw AS (SELECT line, term, coalesce(idf, ln(1.0 + n) + 1) AS idf FROM lt LEFT JOIN w USING (term), n),
        norms AS (SELECT line, sqrt(sum(idf * idf)) AS norm FROM lw GROUP BY line),
        cosines AS (SELECT line, name, round(sum(idf * unit) / any_value(norm), 6) AS score
                    FROM lw JOIN units USING (term) JOIN norms USING (line) GROUP BY line, name),
        best AS (SELECT doc_id, score, name, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, name) AS r
                 FROM lines JOIN cosines USING (line) WHERE score >= 0.7),
        own AS (SELECT files.doc_id, folder, file, folder || '/' || file AS path, name, score FROM files LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (doc_id)),
        speaking AS (SELECT folder, name, score, row_number() OVER (PARTITION BY folder ORDER BY score DESC, name) AS r
                     FROM own WHERE name IS NOT NULL AND file = 'LICENSE'),
        up AS (SELECT own.*, s.name AS near, s.score AS near_score, row_number() OVER (PARTITION BY own.doc_id ORDER BY len(s.folder) DESC) AS nth
               FROM own LEFT JOIN (SELECT * FROM speaking WHERE r = 1) s ON own.folder = s.folder OR starts_with(own.folder, s.folder || '/'))
        SELECT doc_id, path, coalesce(name, near) AS licence, coalesce(score, near_score) AS score,
               CASE WHEN name IS NOT NULL THEN 'header' WHEN near IS NOT NULL THEN 'inherited' ELSE 'none' END AS how
        FROM up WHERE nth = 1"""

# CRC-32 of a short ASCII text, bit by bit.
_CRC_STEP = "list_reduce(range(8), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), {})"
_CRC = f"xor(list_reduce(list_transform(string_split({{}}, ''), lambda b: CAST(ord(b) AS BIGINT)), lambda c, b: {_CRC_STEP.format('xor(c, b)')}, 4294967295), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": r"""
        WITH RECURSIVE docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(3, len(w)) - 1], ' ') AS g
                  FROM (SELECT *, unnest(range(1, len(w) - least(3, len(w)) + 2)) AS i FROM docs WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * shared >= 85 * (s.n + t.n - shared)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
        least AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
        FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN least ON a = doc_id""",
    "op8_substrings": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        spots AS (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS words FROM (SELECT *, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50)),
        first AS (SELECT words, min(doc_id) AS least FROM spots GROUP BY words),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM spots JOIN first USING (words) WHERE least < doc_id),
        each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS text FROM each ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
        removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM docs LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op4_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op5_decontaminate": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        items AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
        windows AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS words
                    FROM (SELECT *, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
        sizes AS (SELECT DISTINCT n FROM windows),
        spots AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS words
                  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes WHERE len(w) >= n)),
        found AS (SELECT doc_id, item_id, i, n FROM spots JOIN windows USING (n, words)),
        hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
        ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
                FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
    "op6_lines": r"""
        WITH cut AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
        lines AS (SELECT doc_id, source, line, i, trim(line, ' ' || chr(9) || chr(13)) AS plain
                  FROM (SELECT doc_id, source, unnest(l) AS line, unnest(range(len(l))) AS i FROM cut)),
        common AS (SELECT plain FROM lines WHERE plain <> '' GROUP BY plain HAVING count(DISTINCT coalesce('=' || source, 'null')) >= 10),
        marked AS (SELECT *, plain IN (SELECT plain FROM common) AS gone FROM lines)
        SELECT doc_id, CASE WHEN count(*) = 1 AND max(line) = '' THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op7_licences": LICENCE_SQL,
    "op11_hard_negatives": """
        WITH rows AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
                      FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (SELECT a.r AS ar, a.id AS anchor, a.label AS al, b.r AS br, b.id AS other, b.label AS bl, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
                   FROM rows a, rows b WHERE a.id % 100 = 0),
        pos AS (SELECT ar, anchor, al, br, other, score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, other) AS p
                FROM scored WHERE al = bl AND ar <> br),
        neg AS (SELECT pos.ar, pos.anchor, pos.br, pos.other AS positive, pos.score AS ps, s.other AS negative, s.score AS ns,
                       row_number() OVER (PARTITION BY pos.ar, pos.br ORDER BY s.score DESC, s.other) AS rank
                FROM pos JOIN scored s ON pos.ar = s.ar WHERE p <= 5 AND s.al <> s.bl AND 80 * pos.score <= 100 * s.score AND s.score <= pos.score)
        SELECT anchor AS anchor_id, positive AS positive_id, CAST(rank AS INTEGER) AS rank, negative AS negative_id, ps AS positive_score, ns AS negative_score
        FROM neg WHERE rank <= 5""",
    "op13_conversation_trie": rf"""
        WITH turns AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        own AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, md5(octet_length(encode(role)) || ':' || role || text)) AS l FROM turns GROUP BY c),
        cut AS (SELECT *, {_CRC.format("CAST(c AS VARCHAR)")} % 4 AS h FROM own),
        whole AS (SELECT cut.c, list_concat(coalesce(b.l[:cut.h], []), cut.l[cut.h + 1 :]) AS l FROM cut LEFT JOIN own b ON b.c = cut.c - cut.c % 20),
        steps AS (SELECT c, l, unnest(range(len(l) + 1)) AS d FROM whole),
        nodes AS (SELECT l[:d] AS p, d, min(c) AS conv_id, count(*) AS n, count(*) FILTER (len(l) = d) AS done,
                         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends
                  FROM steps GROUP BY ALL),
        kids AS (SELECT p[: d - 1] AS q, d - 1 AS e, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL),
        own_part AS (SELECT p, d, CAST(done = n AS BIGINT) AS leaf,
                            (n - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d].text, '[^\x20\x09-\x0D]+')) END AS tokens FROM nodes),
        sums AS (SELECT p[:e] AS q, e, sum(leaf) AS leaves, sum(tokens) AS tokens FROM (SELECT *, unnest(range(d + 1)) AS e FROM own_part) GROUP BY ALL)
        SELECT nodes.conv_id, nodes.d AS depth, up.conv_id AS parent_conv_id, nodes.n AS n_convs, coalesce(k, 0) AS n_children,
               CAST(leaves AS BIGINT) AS n_leaves, CAST(tokens AS BIGINT) AS saved_tokens, nodes.ends AS ends_sha256
        FROM nodes LEFT JOIN nodes up ON nodes.d > 0 AND up.d = nodes.d - 1 AND up.p = nodes.p[: nodes.d - 1]
        LEFT JOIN kids ON kids.e = nodes.d AND kids.q = nodes.p JOIN sums ON sums.e = nodes.d AND sums.q = nodes.p""",
}
