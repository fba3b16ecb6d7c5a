"""A training corpus from raw documents: five operators one after another.

``STAGES`` lists the stages in order. Each takes ``(spark, docs, sf_dir)`` and
returns a DataFrame; it is written as Parquet and read again as the next one's
``docs``. All but the last return the columns of ``documents``; the last adds the ids of the encoded text.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairspace.llm import decontaminate, jaccard_join, line_dedup, pieces, toxicity
from pairspace.llm.queries import QUERIES, SQL, table
from pairspace.llm.rows import pack
from pairspace.plans.storage import materialise

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar, learnt from the labelled ones among them, does not predict to be toxic.

    Where the labels teach no word, as without labels of both classes, there is nothing to judge by, and all stay.
    """
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    if not model.lexicon.words and not model.lexicon.stems:
        return docs
    return toxicity.score(docs, "text", model).filter("predicted = 0").select(*docs.columns)


def cut_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate of their source; ``n_chars`` follows the text."""
    done = line_dedup.dedup_lines(docs, "source", "text")
    return done.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id.

    Documents without words or without an id stay. Rows of one id are one document, of which the smallest row stays.
    """
    found = jaccard_join.near_duplicates(docs, "doc_id", "text").filter("doc_id is not null")
    ids = found.groupBy("doc_id").agg(F.max((F.col("doc_id") == F.col("component_id")).cast("int")).alias("stays"), F.count("*").alias("n"))
    # mostly few: Spark broadcasts them when their stored size is small
    marked = materialise(ids.filter("stays = 0 or n > 1"), "pipeline-marked")
    lone = docs.join(marked.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)
    several = docs.join(marked.filter("stays = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    least = several.groupBy("doc_id").agg(F.min(pack(several)).alias("row")).select("row.*")
    return lone.unionByName(least)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word passage of a benchmark item."""
    found = decontaminate.find_benchmark(docs, "text", table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.filter("not contaminated").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with ``piece_ids``. Few words are remembered: the workers' memory stays taken in the stages that follow in the same session."""
    return pieces.encode_texts(docs, "text", public_tokenizers.path("piece_bpe_32k.model"), remembered=100_000)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line dedup", cut_boilerplate),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

# the first stage learns its words, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored before the next stage reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {**QUERIES, "pipeline": run}
