"""A training corpus from documents: quality, near copies, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns the columns of documents, the last one the tokens. Its
result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terralith.llm import bpe, jaccard, mixing, quality, secrets
from terralith.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or that are more likely bad than good, go.

    Null and empty texts have no words and go; repeated rows are judged alike, each by itself; a posterior of just one half
    stays; an empty table stays empty.
    """
    return quality.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of near copies stays.

    Rows of one doc_id are one document and stay or go together; null doc_ids, and texts without words, are copies of
    nothing and stay; an empty table stays empty.
    """
    return jaccard.representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind.

    Rows are neither added nor lost; null texts stay null; repeated rows are changed alike; overlapping secrets become one
    mark, of the kind that starts first.
    """
    return secrets.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, until each source has its share of the words.

    Null or wordless texts go; null sources are one source; equal rows at a source's border share its words evenly and so may
    be rounded away; reruns choose the same rows; an empty table stays empty.
    """
    return mixing.resample(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and digests of every row.

    Null texts are encoded as empty ones; repeated rows, which the mix makes, get equal ids, a row each.
    """
    return bpe.encode(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", secret_scan),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]

#: EM and BPE are not SQL; tests hold each stage's operator against brute force, and the pipeline's stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + "-".join(name.lower().split()))
    return docs
