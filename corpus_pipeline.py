"""The corpus pipeline: documents that the toxicity model rejects go, repeated lines go,
one document of each group of near copies stays, sources are mixed to target weights,
and what remains is encoded in pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import jaccard, lines, mixing, pieces, toxicity
from quillon.llm.shared import save

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", lines.stage),
    ("ngram_jaccard", jaccard.stage),
    ("mixing", mixing.stage),
    ("pieces", pieces.stage),
]

#: No SQL: a trained model decides in the first stage, edit distances in the second, set
#: components in the third. Tests hold each stage's operator against brute force, and run the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(spark, stage(spark, docs, sf_dir), name)
    return docs
