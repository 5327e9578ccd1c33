"""The registered queries of this subpackage: thin calls of its operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_duplicates, language, mixing, near_duplicates, order_minhash, quality, secrets, sentence_pieces, token_files
from .common import ship, stored

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-BPE ids with end id 2 in coded shards, read back from the files."""
    docs = _table(spark, sf_dir, "documents")
    manifest = token_files.write_shards(docs, token_files.scratch(spark, "rans"), public_tokenizers.path(BYTE_BPE), end_id=2)
    return token_files.read_shards(manifest)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from the labels of four folds of five."""
    stats = stored(quality.document_statistics(_table(spark, sf_dir, "documents")), "statistics")
    labels = _table(spark, sf_dir, "labels")
    model = quality.fit(stats, labels.filter(quality.fold(labels["doc_id"]) != 0))
    scored = quality.score(stats, model)
    return scored.select("doc_id", (quality.fold(scored["doc_id"]) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A language for every document, from dictionaries of texts of four folds of five."""
    docs = _table(spark, sf_dir, "documents")
    contents = language.dictionaries(docs.filter(quality.fold(docs["doc_id"]) != 0))
    found = language.classify(docs, contents)
    return found.select("doc_id", (quality.fold(found["doc_id"]) == 0).alias("held_out"), "lang_pred", "score", "confident")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose two-word shingles agree to 80 per cent."""
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order min-hash of every document, held against its edited text and the next document."""
    return order_minhash.edit_likeness(_table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words a mix of all sources by weights 1, 2, 3 takes of each document."""
    docs = _table(spark, sf_dir, "documents")
    rows, sizes, targets = mixing.mix(docs, F.array(docs["source"]))
    facts = spark.createDataFrame([([s], sizes[s], targets[s]) for s in sizes], "p array<string>, source_size long, target double")
    return rows.join(mixing.small(facts, len(sizes)), F.col("sources") == F.col("p")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text, and the text from them, as digests."""
    return sentence_pieces.encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), ids=False, decoded=False, digests=True)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text, as counts, a digest of the base spans and all spans."""
    return secrets.scan(_table(spark, sf_dir, "documents"), digests=True)


def op9_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at a cosine of 0.95."""
    return embedding_duplicates.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document, end id included, counted in flat files by a scan for end ids."""
    end = 50256
    order = token_files.write_flat(_table(spark, sf_dir, "documents"), token_files.scratch(spark, "flat"), public_tokenizers.path(BYTE_BPE), end_id=end)
    counted = token_files.scan_flat(order.select("file"), end_id=end)
    # the order table packs so well on disk that Spark would take it for small and broadcast it
    return order.join(counted.hint("merge"), ["file", "seq"]).select("doc_id", "n_tokens", "closed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_binary, op2_quality, op3_language, op4_near_duplicates, op5_fingerprint, op6_mixing, op7_sentencepiece, op8_secrets, op9_embedding_duplicates, op10_token_counts)}


COMPONENTS = """e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 r AS (SELECT id, id c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id), g AS (SELECT id, min(c) c FROM r GROUP BY 1)"""

NEAR_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w FROM documents),
 s AS (SELECT DISTINCT id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) sh FROM w),
 n AS (SELECT w.id, count(s.sh)::BIGINT n FROM w LEFT JOIN s USING (id) GROUP BY 1),
 p AS (SELECT x.id a, y.id b, count(*) c FROM s x JOIN s y ON x.sh = y.sh AND x.id < y.id GROUP BY 1, 2),
 l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * c >= 80 * (x.n + y.n - c)), {COMPONENTS}
 SELECT n.id doc_id, n n_shingles, c component_id, c = n.id kept FROM n JOIN g USING (id)"""

VECTOR_SQL = f"""WITH RECURSIVE n AS (SELECT vec_id id, embedding::DOUBLE[] v FROM embeddings),
 l AS (SELECT x.id a, y.id b FROM n x JOIN n y ON x.id < y.id WHERE list_cosine_similarity(x.v, y.v) >= 0.95), {COMPONENTS},
 k AS (SELECT a, count(*)::BIGINT k FROM e GROUP BY 1)
 SELECT n.id vec_id, coalesce(k, 0)::BIGINT n_links, c component_id, c = n.id kept FROM n JOIN g USING (id) LEFT JOIN k ON k.a = n.id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the two that it can express; the tests hold the others against the libraries, brute force or held-out labels."""
    return {"op4_near_duplicates": NEAR_SQL, "op9_embedding_duplicates": VECTOR_SQL}
