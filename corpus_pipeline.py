"""A training corpus from raw documents: quality rules, near-duplicate removal, masking, mixing, tokens.

Each stage takes (spark, docs, sf_dir), works on all documents that its predecessor kept, and returns a DataFrame, which is
written as Parquet and read again for the next stage. All but the last return the columns of documents.

A null or empty text has no words, so the quality rules drop it; a null id, source or language is passed on, and so are repeated
rows, of which the near-duplicate stage keeps one. Texts are taken whole, however long. Columns besides those of documents go
through, whatever their names. An empty table gives an empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiza.llm import byte_bpe, mixing, ngram_join, pii, quality_rules
from tiza.llm.common import shared_dir, table


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host isn't rejected."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest doc_id."""
    return ngram_join.keep_first(docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by [KIND]; n_chars follows."""
    return pii.mask_pii(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in mixing order: the files that are written hold them in that order."""
    return mixing.mixed_order(docs)


#: Bits of a position for the number of a task's file and of a file's row.
FILE_BITS, ROW_BITS = 18, 24


def placed(docs: DataFrame) -> DataFrame:
    """(position, doc_id, text) of docs read from files that Spark wrote: positions are distinct and rise in the order of the files' rows.

    A position is made of the number of the task that wrote the file, the file's number within the task, and the row's number in
    the file; numbers that don't fit their bits raise an error."""
    at = lambda rx: F.regexp_extract("_metadata.file_name", rx, 1).cast("long")
    task, file, row = at("^part-([0-9]+)"), at("-c([0-9]+)[.]"), F.col("_metadata.row_index")
    fits = (task < 1 << 63 - FILE_BITS - ROW_BITS) & (file < 1 << FILE_BITS) & (row < 1 << ROW_BITS)
    position = F.when(fits, F.shiftleft(task, FILE_BITS + ROW_BITS) + F.shiftleft(file, ROW_BITS) + row).otherwise(F.raise_error(F.lit("too many tasks, files or rows for a position")).cast("bigint"))
    return docs.select(position.alias("position"), "doc_id", "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, position) of each document's tokens; position is its place in the mixing order."""
    rows = placed(docs)
    made = byte_bpe.digests(rows, id_col="position").withColumnRenamed("doc_id", "position")
    return made.join(rows.select("position", "doc_id"), "position").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "position")


STAGES = [("quality_rules", rules), ("ngram_join", near_duplicates), ("pii", mask), ("mixing", mixed), ("byte_bpe", tokens)]
#: Groups of near copies, masked spans and tokens are beyond SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over documents, sorted by position: in mixing order. Stages pass their documents on through files in the shared folder.

    The position itself stays in the last stage's files; sorting their digests needs none of the texts."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_dir(spark)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
    return docs.orderBy("position").drop("position")
