"""A corpus pipeline: documents pass through five stages, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next one's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixloom.llm import decontaminate, fuzzy_lines, jaccard, pieces, quality
from pixloom.llm.frame import saved

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None  # trained models and near duplicates: tested against brute force instead


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*(F.col(c) for c in COLUMNS))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts to be good."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _columns(quality.quality_score(docs, labels).where("predicted = 1"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that stand elsewhere before; a document left without any word goes."""
    kept = fuzzy_lines.remove_lines(docs)
    emptied = F.col("removed").isNotNull() & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return _columns(kept.where(~emptied).withColumn("n_chars", F.length("text").cast("long")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near duplicates: five-word shingles, from 0.8."""
    return _columns(jaccard.keep_one(docs, shingle=5, percent=80))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark phrases; a document left without any word goes."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.remove_spans(decontaminate.find_benchmark(docs, benchmark))
    emptied = (F.size("hit_spans") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    return _columns(found.where(~emptied).withColumn("n_chars", F.length("text").cast("long")))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text's pieces, with the number of them and whether they decode to the text."""
    both = pieces.encode_and_decode(docs, pieces.Model())
    same = F.col("decoded").eqNullSafe(F.translate("text", pieces.BLANK, " "))
    return both.select("doc_id", "lang", "source", F.coalesce(F.size("ids"), F.lit(0)).alias("n_pieces"), "ids", same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", benchmark_stage),
    ("SentencePiece encoding", pieces_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
