"""A training-data pipeline over ``documents``: five stages, each one of the operators.

Every stage takes the documents that the one before has kept, as Parquet, and
all but the last return the columns of ``documents``.

1. quality: documents whose score is under 0.3 go.
2. near_duplicates: of each group of five-word-shingle similarity 0.8 or more, the
   document with the least id stays. Rows count by their texts: rows of one id with
   different texts all stay, copies among rows with a null id go (they come after
   all ids). Of rows without words one an id stays; with a null id, all.
3. secrets: spans are replaced by ``[kind]``; no document goes.
4. mixing: sources weigh 1, 2, 3 by code point; a document comes back as often as
   the mix takes it, at most three times, and not at all if it takes none.
5. encode: SentencePiece ids of every document.

Null texts count as empty, null ids and sources as described in the operators;
empty tables give empty results; extra columns pass through to the last stage,
which returns doc_id, source, n_tokens and ids.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import mixing, near_duplicates, quality, secrets, sentence_pieces
from lattica.llm.common import new_path, ship, stored

THRESHOLD = 0.3
#: SQL cannot express these stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents among ``docs`` outside the held-out fold; all are scored."""
    ship(spark)
    stats = stored(quality.document_statistics(docs), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.fit(stats, labels.filter(quality.fold(labels["doc_id"]) != 0))
    scored = quality.score_documents(docs, model)
    return scored.filter(F.col(quality.SCORE) >= THRESHOLD).drop(quality.SCORE)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group the row with the least id; rows are told apart by a key made for them, not by their ids."""
    ship(spark)
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")  # written, so that the keys stay
    groups = near_duplicates.near_duplicates(rows, width=5, percent=80, id_col="__row").select(F.col("doc_id").alias("__row"), "n_shingles", "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", F.xxhash64("text").alias("text"), "__row")
    placed = stored(groups.join(rows.select("__row", "doc_id", order.alias("order")), "__row"), "placed")
    worded = F.col("n_shingles") > 0
    group = [F.when(worded, F.col("component_id")).when(F.col("doc_id").isNull(), F.col("__row")).alias("a"), F.when(~worded, F.col("doc_id")).alias("b")]
    kept = placed.groupBy(*group, worded.alias("c")).agg(F.min("order").alias("least")).select("least.__row")
    gone = stored(placed.select("__row").join(kept, "__row", "left_anti"), "gone")
    return rows.join(gone, "__row", "left_anti").select(*[rows[c] for c in docs.columns])


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redacts secrets in the texts; n_chars follows where the table has it."""
    ship(spark)
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it."""
    ship(spark)
    rows, _, _ = mixing.mix(docs, F.array(docs["source"]), keep=True)
    return rows.filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("__turn")).select("row.*")


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids, begin and end ids included, beside each document's id and source."""
    ship(spark)
    return sentence_pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), decoded=False, keep=("source",))


STAGES = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each result written to the shared folder and read again."""

    def step(docs: DataFrame, stage) -> DataFrame:
        path = new_path(spark, "stage")
        stage[1](spark, docs, sf_dir).write.parquet(path)
        return spark.read.parquet(path)

    return functools.reduce(step, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"))
