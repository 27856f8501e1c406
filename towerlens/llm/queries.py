"""The registered queries of the operators in this subpackage, and their SQL where SQL can say it."""

import public_tokenizers
from pyspark.sql import functions as F

from towerlens.llm import (
    chat,
    conversations,
    exact_dedup,
    html_extract,
    jaccard_join,
    language,
    mixing,
    packing,
    prefix_trie,
    quality,
    structure,
    substring_dedup,
    token_files,
    warc,
)
from towerlens.session import materialise, work_folder

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark, sf_dir):
    pieces = packing.pieces(
        _read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), CAPACITY
    )
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.place(slim, CAPACITY)


def op2_substring_dedup(spark, sf_dir):
    return substring_dedup.removed_spans(_read(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (
    SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.!?]) ', '\1' || chr(10), 'g'), chr(10)) AS lines
    FROM documents
), l AS (
    SELECT doc_id, unnest(range(1, len(lines) + 1)) AS unit, unnest(lines) AS line FROM t
), o AS (
    SELECT doc_id, unit, line,
           sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit) - length(line) - 1 AS start,
           regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS w
    FROM l
), u AS (
    SELECT doc_id, unit, start, start + length(line) AS stop, len(w) AS n_words,
           array_to_string(w, ' ') AS g, row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS n
    FROM o WHERE len(w) >= 4
), r AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY g ORDER BY doc_id, unit) AS keep_id,
           row_number() OVER (PARTITION BY g ORDER BY doc_id, unit) AS place
    FROM u
), m AS (
    SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS run FROM r WHERE place > 1
)
SELECT doc_id, CAST(min(start) AS BIGINT) AS start, CAST(max(stop) AS BIGINT) AS stop,
       CAST(sum(n_words) AS BIGINT) AS n_words, count(*) AS n_units, arg_min(keep_id, unit) AS keep_id
FROM m GROUP BY doc_id, run HAVING sum(n_words) >= 25
"""


def op3_token_files(spark, sf_dir):
    folder = f"{work_folder(spark)}/tokens"
    token_files.write(_read(spark, sf_dir, "documents"), folder, public_tokenizers.path(TOKENIZER))
    return token_files.digests(spark, folder)


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.groups(_read(spark, sf_dir, "documents")).drop("bucket")


OP4_SQL = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS points,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
    FROM documents
), k AS (
    SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
           first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id
    FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM k
"""


def op5_jaccard_join(spark, sf_dir):
    found = jaccard_join.links(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "n_links")


OP5_SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (
    SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
    FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (
    SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id
    WHERE k >= 0.8 * (x.n + y.n - k) - 1e-9
), e AS (
    SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
    SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
)
SELECT doc_id,
       least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = doc_id), doc_id)) AS class_id,
       (SELECT count(*) FROM e WHERE a = doc_id) AS n_links
FROM documents
"""


def op6_mixing(spark, sf_dir):
    return mixing.taken(_read(spark, sf_dir, "documents"))


def op7_chat(spark, sf_dir):
    return chat.repaired(_read(spark, sf_dir, "conversations"))


def op8_quality(spark, sf_dir):
    found = quality.judged(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score",
    )


def op9_language_id(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    found = language.predict(docs.select("doc_id", "text"), language.fit(docs.filter(fold != 2)))
    return found.select(
        "doc_id",
        F.coalesce(fold == 2, F.lit(False)).alias("held_out"),
        "lang_pred",
        "score",
        "accepted",
    )


def op10_warc(spark, sf_dir):
    folder = f"{work_folder(spark)}/warc"
    warc.write(_read(spark, sf_dir, "pages"), folder).write.mode("overwrite").parquet(f"{folder}-files")
    records = warc.read(spark, folder, payloads=False, files=spark.read.parquet(f"{folder}-files"))
    return records.filter(F.col("record_type").isin("response", "revisit")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


OP10_SQL = """
WITH p AS (
    SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), k AS (
    SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM k
"""


def op11_prefix_trie(spark, sf_dir):
    """Nodes of the prefix tree; turns of one number follow each other by role, then by digest."""
    turns = _read(spark, sf_dir, "conversations")
    return prefix_trie.nodes(
        conversations.rebuilt(turns), conversations.members(turns), ("section", "place")
    )


OP11_SQL = """
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
), g AS (
    SELECT conv_id, turn, role, strlen(text) AS size,
           left(sha256(strlen(role) || ':' || role || strlen(text) || ':' || text), 32) AS g FROM t
), o AS (
    SELECT conv_id, g, size,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, g) AS i FROM g
), c AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
           xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT,
                            list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
               lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
                                        lambda d, z: xor(d >> 1, 3988292384 * (d & 1))))) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
    SELECT c.conv_id, 0 AS s, i, g, size FROM c JOIN o ON o.conv_id = c.base WHERE i <= h
    UNION ALL
    SELECT o.conv_id, 1, i, g, size FROM o LEFT JOIN c ON o.conv_id = c.conv_id WHERE coalesce(i > h, true)
), d AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY s, i) AS depth, g, size FROM r
), l AS (
    SELECT conv_id, list(g ORDER BY depth) AS gs FROM d GROUP BY conv_id
), p AS (
    SELECT d.conv_id, depth, size, depth = len(gs) AS last, array_to_string(gs[1:depth], '') AS k,
           array_to_string(gs[1:depth - 1], '') AS pk
    FROM d JOIN l ON d.conv_id IS NOT DISTINCT FROM l.conv_id
    UNION ALL
    SELECT c.conv_id, 0, 0, l.gs IS NULL, '', NULL
    FROM c LEFT JOIN l ON c.conv_id IS NOT DISTINCT FROM l.conv_id
), n AS (
    SELECT k, any_value(pk) AS pk, max(depth) AS depth, min(conv_id) AS rep, count(*) AS n, max(size) AS size,
           coalesce(string_agg(CASE WHEN last THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends
    FROM p GROUP BY k
), m AS (
    SELECT n.*, coalesce(x.kids, 0) AS kids FROM n
    LEFT JOIN (SELECT pk, count(*) AS kids FROM n WHERE pk IS NOT NULL GROUP BY pk) x ON x.pk = n.k
), a AS (
    SELECT p.k, sum(CASE WHEN m.kids = 0 THEN 1 ELSE 0 END) OVER w AS leaves,
           sum(coalesce((m.n - 1) * m.size, 0)) OVER w AS saved
    FROM p LEFT JOIN m ON m.k = p.k AND m.rep IS NOT DISTINCT FROM p.conv_id
    WINDOW w AS (PARTITION BY p.conv_id ORDER BY p.depth DESC)
), s AS (
    SELECT k, sum(leaves) AS leaves, sum(saved) AS saved FROM a GROUP BY k
)
SELECT m.rep AS conv_id, CAST(m.depth AS BIGINT) AS depth, u.rep AS parent_conv_id, m.n AS n_convs,
       CAST(m.kids AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN s ON s.k = m.k LEFT JOIN n u ON u.k = m.pk
"""


def op12_structure_repair(spark, sf_dir):
    turns = _read(spark, sf_dir, "conversations")
    found = structure.faults(conversations.damaged(turns))
    made = structure.summary(found, materialise(structure.repaired(found)))
    made = made.withColumnRenamed("conv_id", "_conv")
    every = conversations.members(turns)
    rows = every.join(made, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return rows.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).withColumns(
        {
            "audit": F.coalesce("audit", F.lit("")),
            "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)),
        }
    )


def op13_html_extract(spark, sf_dir):
    return html_extract.extracted(_read(spark, sf_dir, "pages"))


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_token_files": op3_token_files,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_mixing": op6_mixing,
    "op7_chat": op7_chat,
    "op8_quality": op8_quality,
    "op9_language_id": op9_language_id,
    "op10_warc": op10_warc,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_structure_repair": op12_structure_repair,
    "op13_html_extract": op13_html_extract,
}
ORACLE = {
    "op2_substring_dedup": OP2_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op5_jaccard_join": OP5_SQL,
    "op10_warc": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
}
