"""The registered queries: each operator on its whole table, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    ann,
    exactdedup,
    langid,
    mixing,
    neardup,
    negatives,
    packing,
    pagetext,
    prefixtrie,
    quality,
    suffixdedup,
    tokenfile,
    wordpiece,
)
from .common import fold, shared_folder, ship

try:
    import public_tokenizers
except ImportError:  # the tokenizers' folder is a parameter of the operators
    import sys

    sys.path.append("/opt/tokenizers")
    public_tokenizers = None

END_OF_FILE_DOCUMENT = 2
END_OF_PACKED_DOCUMENT = 1


def tokenizer_path(name: str) -> str:
    if public_tokenizers is None:
        return f"/opt/tokenizers/{name}"
    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _fold_is(key: str, parts: int, fold_number: int) -> Column:
    """Whether a row is in that fold; one without an id is in none."""
    return F.coalesce(fold(F.col(key), parts) == fold_number, F.lit(False))


def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = _fold_is("doc_id", 5, 0)
    found = langid.identify(docs, ~held_out, "text", "lang", "found")
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
    )


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").select("doc_id", "quality")
    held_out = _fold_is("doc_id", 4, 2)
    model = quality.train(docs.filter(~held_out), labels.filter(~held_out))
    return model.predict(docs, "text", "score").select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exactdedup.exact_duplicates(_table(spark, folder, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept,
       text_sha256
FROM d
"""


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url", "html")
    return pagetext.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    counts = wordpiece.token_counts(docs, tokenizer_path("word_bpe_49k.json"))
    return counts.select("doc_id", "counts.*")


def op6_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents")).drop("digest")


def op7_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    index = ann.Index(_table(spark, folder, "embeddings"), "vec_id", "embedding", k=20)
    return index.search(F.pmod("id", F.lit(20)) == 0)


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    where = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    path = tokenizer_path("byte_bpe_50k.json")
    tokenfile.write_token_files(docs, where, path, END_OF_FILE_DOCUMENT)
    return tokenfile.read_token_files(spark, where).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def packed_pieces(docs: DataFrame) -> DataFrame:
    """The pieces of ``docs`` with checksums of their ids."""
    path = tokenizer_path("byte_bpe_50k.json")
    return packing.pack(docs, path, END_OF_PACKED_DOCUMENT).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed_pieces(_table(spark, folder, "documents"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return mixing.mix(docs).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    moved = F.when(
        F.pmod("vec_id", F.lit(7)) == 0, (F.col("label").cast("long") + 1) % 10
    ).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", moved), F.pmod("id", F.lit(100)) == 0)


OP11_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS grid
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pairs AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, o.uid AS other, o.vec_id AS other_id,
         list_inner_product(a.grid, o.grid)::BIGINT AS score, a.label = o.label AS same
  FROM v a JOIN v o ON a.uid <> o.uid AND len(a.grid) = len(o.grid)
  WHERE a.vec_id % 100 = 0
),
positives AS (
  SELECT * FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other_id NULLS LAST) <= 5
),
inside AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id,
         p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.other
                            ORDER BY n.score DESC, n.other_id NULLS LAST)::INT AS rank
  FROM positives p JOIN pairs n ON n.anchor = p.anchor AND NOT n.same
  WHERE 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score
FROM inside WHERE rank <= 5
"""


def op12_repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    found = suffixdedup.without_repeats(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["length"])
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP12_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, hex(encode(coalesce(text, ''))) AS bytes
  FROM documents
),
strings AS (
  SELECT uid, doc_id, p, substr(bytes, 2 * p + 1, 100) AS s
  FROM d, unnest(range(len(bytes) // 2 - 49)) AS t(p)
),
earliest AS (
  SELECT s, min(coalesce(doc_id, 9223372036854775807)) AS least
  FROM strings GROUP BY s HAVING count(*) > 1
),
hits AS (
  SELECT uid, p, lag(p) OVER (PARTITION BY uid ORDER BY p) AS before
  FROM strings JOIN earliest USING (s)
  WHERE least < coalesce(doc_id, 9223372036854775807)
),
numbered AS (
  SELECT uid, p,
         count(*) FILTER (WHERE before IS NULL OR p - before > 50)
           OVER (PARTITION BY uid ORDER BY p) AS span
  FROM hits
),
spans AS (
  SELECT uid, min(p) AS first, max(p) + 50 AS after FROM numbered GROUP BY uid, span
),
stays AS (
  SELECT uid, coalesce(lag(after) OVER w, 0) AS a, first AS b, after - first AS gone
  FROM spans WINDOW w AS (PARTITION BY uid ORDER BY first)
  UNION ALL
  SELECT uid, max(after), 1000000000, 0 FROM spans GROUP BY uid
),
parts AS (
  SELECT uid, sum(gone)::BIGINT AS n_removed, count(*) - 1 AS n_spans,
         string_agg(substr(bytes, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept
  FROM stays JOIN d USING (uid) GROUP BY uid
)
SELECT doc_id, len(bytes) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed,
       coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, bytes))) AS kept_sha256
FROM d LEFT JOIN parts USING (uid)
"""


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    turns = prefixtrie.turns_in_order(_table(spark, folder, "conversations"))
    group = F.col("conv_id") - F.col("conv_id") % 5
    return prefixtrie.prefix_trie(
        prefixtrie.with_shared_starts(turns, group, fold(F.col("conv_id"), 9))
    )


# DuckDB has no crc32: a conversation's number goes through the polynomial bit by bit.
OP13_SQL = """
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, count(*) AS turns,
         xor(list_reduce(
           list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
           lambda crc, byte: list_reduce(
             range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)),
           4294967295::BIGINT), 4294967295) % 9 AS h
  FROM turns GROUP BY conv_id
),
sized AS (
  SELECT c.*, least(c.h, coalesce(b.turns, 0)) AS taken
  FROM convs c LEFT JOIN convs b ON b.conv_id = c.base
),
rebuilt AS (
  SELECT s.conv_id, t.n AS depth, t.role, t.text
  FROM sized s JOIN turns t ON t.conv_id = s.base AND t.n <= s.taken
  UNION ALL
  SELECT s.conv_id, t.n - s.h + s.taken, t.role, t.text
  FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND t.n > s.h
),
member AS (
  SELECT conv_id, depth, strlen(text) AS n_bytes,
         string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '')
           OVER (PARTITION BY conv_id ORDER BY depth) AS path,
         depth = max(depth) OVER (PARTITION BY conv_id) AS ends
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM rebuilt) FROM convs
),
keyed AS (
  SELECT conv_id, depth, n_bytes, ends, md5(path) AS node,
         lag(md5(path)) OVER (PARTITION BY conv_id ORDER BY depth) AS parent
  FROM member
),
node AS (
  SELECT node, parent, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         any_value(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)
           FILTER (WHERE ends), '')) AS ends_sha256
  FROM keyed GROUP BY ALL
),
children AS (SELECT parent, count(*) AS n_children FROM node GROUP BY parent),
known AS (
  SELECT n.*, coalesce(c.n_children, 0) AS n_children
  FROM node n LEFT JOIN children c ON c.parent = n.node
),
subtree AS (
  SELECT above.node, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves,
         sum((k.n_convs - 1) * k.n_bytes)::BIGINT AS saved_tokens
  FROM known k JOIN keyed above ON above.conv_id = k.conv_id AND above.depth <= k.depth
  GROUP BY above.node
)
SELECT k.conv_id, k.depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children,
       s.n_leaves, s.saved_tokens, k.ends_sha256
FROM known k JOIN subtree s ON s.node = k.node LEFT JOIN node p ON p.node = k.parent
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_quality,
        op3_exact_dedup,
        op4_html_text,
        op5_token_counts,
        op6_near_dedup,
        op7_nearest_vectors,
        op8_token_files,
        op9_packing,
        op10_mixing,
        op11_hard_negatives,
        op12_repeated_bytes,
        op13_prefix_trie,
    )
}
SQL: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op11_hard_negatives": OP11_SQL,
    "op12_repeated_bytes": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
