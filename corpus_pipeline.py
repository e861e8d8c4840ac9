"""From raw documents to packed training sequences, in stages that build on each other.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and reread as the next one's docs. All but the last return rows of
documents with their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempofeat.llm import decontamination, ngram_join, packing, quality_classifier, quality_rules
from tempofeat.storage import new_folder, remove


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the subword classifier, fitted to these documents' labels, accepts.

    Null, empty and very long texts are scored like others; repeated rows share
    their verdict; without labels everything scores alike and stays."""
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.kept(docs, model)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the quality rules with thresholds adapted to these documents.

    Null and empty texts fail, as texts of few words do; a null language or
    source is one of its own; ties at a threshold stay; repeated rows share
    their verdict."""
    return quality_rules.judge(docs).where("__kept").select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the least id, of equal rows one.

    Texts without words stay, each of them; null ids come last."""
    return ngram_join.deduplicated(docs)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of the benchmark; those without words hold none."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences: one row per piece; a null or empty text is its end alone."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", classify),
    ("quality_rules", rules),
    ("near_duplicates", one_of_each),
    ("decontamination", clean_of_benchmark),
    ("packing", sequences),
]

# Trained and tokenised stages are beyond SQL: tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all sequences of the documents that pass every stage.

    Empty tables give no rows; other columns of documents are carried along to
    the last stage. Each stage's rows are written to the shared folder; they are
    removed when the next one's are there."""
    folder, docs, before = new_folder(spark, "corpus"), spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        own = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(own)
        docs = spark.read.parquet(own)
        if before:
            remove(spark, before)
        before = own
    return docs
