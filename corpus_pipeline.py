"""A cleaning pipeline over documents: five stages, each written and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
kept; all but the last return the columns of the documents table.

Cases that hold for all stages: a null text counts as the empty text; null ids and
repeated ids are rows like others, told apart by their texts; an empty table gives an
empty result; very long texts are taken whole; columns beyond those of the documents
table are dropped, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, near_copies, packing, pii, quality_rules
from millrace.llm.common import documents, shared_path, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that fail go, then documents that fail; n_chars follows the text.

    A null or empty text has too few words and goes; repeated rows are judged alike.
    """
    judged = quality_rules.measure(docs.select(*COLUMNS)).withColumn("n_chars", F.length("clean_text").cast("long"))
    row = F.struct("doc_id", F.col("clean_text").alias("text"), "lang", "source", "n_chars", F.lit(True).alias("_kept"))
    # a filter on the verdict would be pushed below the rules and evaluate them twice
    return judged.select(F.inline_outer(F.when(F.col("kept"), F.array(row)))).filter("_kept").select(*COLUMNS)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays, once; a null id is below all others.

    Equal are texts that are identical byte for byte; of repeats of a row one stays.
    """
    kept = exact_dedup.exact_dedup(docs.select(*COLUMNS)).filter("kept")
    return exact_dedup.one_row_per_id(kept).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row stays, that with the smallest id; a null id is above all others.

    Rows are told by id and text: an unlike text stays, though it has the id of a copy that
    goes.  Texts without words are near no other; of repeats of a row one stays.
    """
    return near_copies.firsts(docs.select(*COLUMNS))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text, and is null for a null text.

    Equal values get equal pseudonyms in all rows of a run; repeated rows become alike.
    """
    done = pii.pseudonymise(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence.

    A null or empty text has one piece, its end token; repeated rows are packed once each.
    """
    return packing.pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("exact_dedup", exact),
    ("simhash_near_dedup", near),
    ("pii", private),
    ("best_fit_packing", packed),
]

#: SQL cannot express the near-duplicate, pseudonym and packing stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
