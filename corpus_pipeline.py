"""The pipeline: documents through quality rules, near-duplicate removal, benchmark decontamination and
mixing to token shards.

Each stage reads what the one before it has written. The first three drop documents (and the first one
boilerplate lines); mixing keeps every document and decides the order of the stored rows; the last stage
encodes documents in that stored order and returns one row per document.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portmesh.llm.common import stored, table
from portmesh.llm.jaccard_join import one_of_each
from portmesh.llm.line_frequency import quality_rules
from portmesh.llm.mixing import mix_sources
from portmesh.llm.templates import decontaminate
from portmesh.llm.token_shards import default_tokenizer, token_output


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """In the order of the stored rows, which mixing has set: file after file, row after row. Documents
    that don't come straight from files have no such order and are taken by ``doc_id``."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    order = [F.length(name), name, F.col("_metadata.row_index")]
    try:
        docs.select(*order)
    except AnalysisException:
        order = None
    return token_output(docs, default_tokenizer(), order)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", tokens),
]

#: SQL has no MinHash join, template alignment or tokenizer: the tests hold ``run`` against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
