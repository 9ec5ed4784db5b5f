"""A corpus-cleaning pipeline over ``documents``: toxic texts, near copies, repeated passages and benchmark leaks go, the rest is encoded.

Defined results: null and empty texts are not toxic, have no passage and no
leak, and encode to no pieces; as near copies they are equals, so one id keeps
them. Rows with a null id are never anyone's copy: they pass the near-copy and
passages stages as they are. Rows that share an id are told apart by their
texts: each is judged, and cut, by its own; rows equal in both count once from
the near-copy stage on. An empty table gives an empty one at every stage. All
columns of documents are carried through, whatever further ones there are and
whatever their names, up to the last stage, which returns its own.

Each stage is written to the shared folder under a name of its own and stays
there for the next run's comparison; folders pipeline-* and the operators'
intermediate ones may be deleted once the result has been written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from atlasfold.llm import decontaminate, passages, pieces, simhash, toxicity
from atlasfold.llm.common import shared_dir, table
from atlasfold.llm.queries import tokenizer_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model learnt from ``labels`` scores under 0.5."""
    return toxicity.reject(docs, toxicity.fit_on(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of every group of near copies: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return simhash.keep_one(docs)


def cut_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the paragraphs that another document, of a lesser id, has too; n_chars is made to fit."""
    return passages.remove(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (pieces with merge-dropout) and intact (they decode to the text) of every document."""
    return pieces.encode(docs, tokenizer_file("piece_bpe_32k.model"))


STAGES = [("toxicity", drop_toxic), ("simhash", drop_near_copies), ("passages", cut_passages), ("decontamination", drop_leaks), ("pieces", encode)]

#: Training, fingerprint balls and encodings have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
