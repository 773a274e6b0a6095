"""From raw documents to packed training sequences; part of the training-data package ``codelode.llm``.

Each stage works on the rows that the one before it kept; its input is a written table.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from codelode.llm import config_packing, cube_mix, exact_dedup, set_skipping, toxicity
from codelode.sources.shared import shared_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on labelled rows of ``docs``, holds toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.without_toxic(docs, toxicity.fit_toxicity(docs, labels))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest id stays."""
    return exact_dedup.without_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles, the smallest id stays."""
    return set_skipping.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: none, once or twice."""
    return cube_mix.materialise(docs, cube_mix.mix_sources(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return config_packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic), ("exact dedup", drop_copies), ("n-gram join", drop_near_copies), ("mixing", mix), ("packing", pack),
]

#: SQL can express neither the trained classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        path = f"{shared_folder(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return docs
