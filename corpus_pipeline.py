"""A training-data pipeline over ``documents``: the stages, in order, and ``run``.

Each stage takes the documents that its predecessor kept and works on all of them.  All but the last return the
columns of ``documents``; the last says how many words of each document the mix takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from syndrift.llm import cotrain, decontam, minhash, mixing, secret_scan
from syndrift.llm.store import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the co-trained classifier rejects."""
    pages, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("pages", "labels"))
    scored = cotrain.score(docs, cotrain.train(docs, labels, pages), pages)
    return _without(docs, scored.where(~F.col("kept")))


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest id, of each group of near-duplicates (0.8 or more); of repeated rows all or none."""
    found = minhash.report(minhash.near_duplicates(docs, Scratch(spark, "dedup"), numerator=80))
    return _without(docs, found.where(~F.col("kept")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the contamination rule finds."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.report(decontam.contamination(docs, benchmark, Scratch(spark, "decontam")))
    return _without(docs, found.where("contaminated"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts ``[REDACTED:kind]`` in the place of every secret; the document stays, and n_chars follows its text."""
    return secret_scan.mask(docs, secret_scan.trained(docs)).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target and taken of every document left."""
    return mixing.mix(docs, Scratch(spark, "mix"))


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The documents whose id is not dropped; those without an id stay."""
    return docs.join(dropped.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_anti").select(COLUMNS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classified),
    ("MinHash near-dedup", deduplicated),
    ("benchmark decontamination", decontaminated),
    ("secret scans", masked),
    ("mixing sources to target weights", mixed),
]
#: The classifier and the character models are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each result is written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
