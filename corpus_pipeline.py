"""The training-data pipeline over ``documents``: every stage takes (spark, docs, sf_dir), works on
all documents that the stage before it kept, and is written as Parquet and read again.

1. quality classifier: documents that it rejects go;
2. line dedup: lines that stand earlier go, equal ones of every length and near ones from 30 code points on, and documents of which nothing is left;
3. n-gram Jaccard join: one document of each group of near duplicates stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. SentencePiece: adds the ids of the text, their number, and whether they decode to it.

All but the last return the columns of ``documents``. Null texts pass the first four stages as empty
ones do; repeated rows are rows of their own until they fall to the third stage; texts of any length are
handled whole; an empty table passes all stages; other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pressroom.llm import decontaminate, jaccard_join, line_dedup, quality, sentencepiece_codec
from pressroom.llm.common import written
from pressroom.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_wanted(docs, table(spark, sf_dir, "labels"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs, report=True, max_edits=2, min_chars=30, equal_chars=1)
    changed = F.size("removed_lines") > 0
    done = done.filter(~changed | (F.trim("text") != ""))
    done = done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs, percent=75)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), threshold=0.75, short_items=True)


def tokenization(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", tokenization),
]

# The classifier and the tokenizer have no SQL form; tests compare with a plain version of each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
