"""Views of the given tables in the shapes that the operators take.

Each view has a twin of the same name in :mod:`pairspace.workload.sql`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.annotate import dedup_sentences, rule_annotate, split_sentences, spread
from ..operators.association import feature_scores, jobim_rotate
from ..operators.pairs import noun_pairs
from ..operators.patterns import sentence_patterns
from ..operators.similarity import cosine_distances
from ..plans.storage import materialise

# sentence id = document id and place of the sentence in the document
SENTENCES_PER_DOC = 1 << 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sentences of all documents, ``(sid, text)``."""
    split = split_sentences(table(spark, sf_dir, "documents"))
    numbered = split.select((F.col("doc_id") * SENTENCES_PER_DOC + F.col("pos")).alias("sid"), "text")
    return dedup_sentences(numbered)


def parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated sentences, ``(sid, text, tokens)``."""
    return rule_annotate(spread(sents(spark, sf_dir)))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct noun pairs of the benchmark passages, stored so that their size is known."""
    texts = split_sentences(table(spark, sf_dir, "benchmark"), "item_id").select(
        (F.col("item_id") * SENTENCES_PER_DOC + F.col("pos")).alias("sid"), "text"
    )
    return materialise(noun_pairs(rule_annotate(texts)).select("noun1", "noun2").distinct(), "wanted")


def feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows ``(noun1, noun2, pattern, sentence)`` of all sentences."""
    return sentence_patterns(parses(spark, sf_dir))


def stored_feats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`feats`, stored for plans that read them several times."""
    return materialise(feats(spark, sf_dir), "features")


def jobim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobim_rotate(feats(spark, sf_dir))


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and nations of lineitems, weighted by quantity: ``(jo, bim, cnt)``."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        line.join(part, "l_partkey")
        .join(supplier, "l_suppkey")
        .join(nation, "n_nationkey")
        .groupBy(F.col("p_brand").alias("jo"), F.col("n_name").alias("bim"))
        .agg(F.sum("l_quantity").alias("cnt"))
    )


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by supplier as sparse vectors, ``(id, idx, value)``."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("id"), F.col("l_partkey").alias("idx"))
        .agg(F.sum("l_quantity").alias("value"))
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and partly finished orders by their customer."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("F", "P"))
    return orders.select(F.col("o_orderkey").alias("item"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cluster"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and partly finished orders by their priority and month."""
    orders = table(spark, sf_dir, "orders").filter(F.col("o_orderstatus").isin("O", "P"))
    month = F.date_format("o_orderdate", "yyyy-MM")
    return orders.select(F.col("o_orderkey").alias("item"), F.concat_ws(" ", "o_orderpriority", month).alias("cluster"))


def letters(column) -> object:
    """Digits as letters, so that a name passes the name test."""
    return F.translate(column, "0123456789", "abcdefghij")


def sims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scaled similarities of supplier pairs that sold the same part, ``(l_pair, r_pair, similarity)``."""
    distances = cosine_distances(bought(spark, sf_dir))
    both = distances.select(
        F.explode(
            F.expr(
                """if(row = col, array(named_struct('l', row, 'r', col)),
                      array(named_struct('l', row, 'r', col), named_struct('l', col, 'r', row)))"""
            )
        ).alias("e"),
        F.round((1 - F.col("distance")) * 1000, 6).alias("similarity"),
    )

    def name(key):
        return F.concat(F.lit("s::@::"), letters(key.cast("string")))

    return both.select(name(F.col("e.l")).alias("l_pair"), name(F.col("e.r")).alias("r_pair"), "similarity")


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_scores(feats(spark, sf_dir))
