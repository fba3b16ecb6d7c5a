"""Sentences and their annotation: tokens, lemmas, tags and heads.

A parse is a row ``(sid, text, tokens)`` where ``tokens`` is an array of
structs ``(id, text, lemma, pos, head, dep)``; ids count from 1 and a head of
0 marks the root.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bound, running_starts
from ..plans.once import with_column_once

TOKEN_SCHEMA = "array<struct<id:int,text:string,lemma:string,pos:string,head:int,dep:string>>"

# the same with the places of each token's first character and of the one behind its last, from 0
SPAN_TOKEN_SCHEMA = TOKEN_SCHEMA[:-2] + ",begin:int,end:int>>"

SENTENCE_END = r"[.!?\n|]+"
NOT_LETTERS = r"[^\p{L}]+"
# a text in whole: what ends a sentence belongs to it
SENTENCE = r"[^.!?\n|]+[.!?\n|]*|[.!?\n|]+"
BLANK = r"[\x09-\x0D\x{20}\p{Z}]+"
# words, numbers, and every other visible character by itself
TOKEN = r"[\p{L}\p{M}]+|\p{N}+|[^\p{L}\p{M}\p{N}\p{Z}\x09-\x0D]"

# Closed word classes of the built-in English rule tagger.
CLOSED_CLASSES = {
    "DT": ["the", "a", "an", "this", "that", "it"],
    "IN": ["of", "to", "in", "for", "on", "with", "by", "as", "at", "from"],
    "CC": ["and", "or"],
    "VB": ["is", "was", "be", "are"],
}
# Suffix rules tried in this order on words of no closed class.
SUFFIX_CLASSES = {
    "VBD": r"^\p{L}{3,}(ed|ing)$",
    "RB": r"^\p{L}{3,}ly$",
    "NNS": r"^\p{L}{3,}s$",
    "NN": r"^\p{L}{2,}$",
}
# what a word of these classes ends with
SUFFIXES = {"VBD": ["ed", "ing"], "RB": ["ly"], "NNS": ["s"]}


def split_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, text)`` per non-empty sentence of a document."""
    return (
        docs.select(doc_id, F.posexplode(F.split(text, SENTENCE_END)).alias("pos", "text"))
        .select(doc_id, "pos", F.trim("text").alias("text"))
        .filter(F.col("text") != "")
    )


def sentence_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc_id, pos, text, begin)`` per sentence that holds a visible character.

    Sentences keep the characters that end them; ``text`` stands in the document from place ``begin`` (from 0) on.
    """
    pieces = F.regexp_extract_all(F.col(text), F.lit(SENTENCE), 0)
    placed = bound(
        pieces,
        lambda ps: F.arrays_zip(ps.alias("piece"), running_starts(F.transform(ps, F.length)).alias("start")),
    )
    cut = docs.select(doc_id, F.posexplode(placed).alias("pos", "p")).select(doc_id, "pos", F.col("p.piece").alias("piece"), F.col("p.start").alias("start"))
    begun = cut.withColumn("begun", F.regexp_replace("piece", "^" + BLANK, ""))
    return begun.filter(F.col("begun") != "").select(
        doc_id,
        "pos",
        F.regexp_replace("begun", BLANK + "$", "").alias("text"),
        (F.col("start") + F.length("piece") - F.length("begun")).alias("begin"),
    )


def spread(sentences: DataFrame, sid: str = "sid") -> DataFrame:
    """Deal the sentences out over all tasks before costly row-by-row work.

    Annotation and pattern extraction cost far more time per byte than the
    partition sizes that Spark aims at assume.
    """
    tasks = int(sentences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sentences.repartition(tasks, sid)


def dedup_sentences(sentences: DataFrame, sid: str = "sid", text: str = "text") -> DataFrame:
    """One row per distinct text, under its smallest sentence id."""
    return sentences.groupBy(text).agg(F.min(sid).alias(sid)).select(sid, text)


def tag(word: Column) -> Column:
    """Rule tag of a lower-case word."""
    rule = F.lit("SYM")
    for pos, pattern in reversed(SUFFIX_CLASSES.items()):
        # plain comparisons spare most words the regular expression
        ends = [word.endswith(e) for e in SUFFIXES.get(pos, [])]
        matches = reduce(lambda x, y: x | y, ends) & word.rlike(pattern) if ends else word.rlike(pattern)
        rule = F.when(matches, F.lit(pos)).otherwise(rule)
    closed = rule
    for pos, words in CLOSED_CLASSES.items():
        closed = F.when(word.isin(words), F.lit(pos)).otherwise(closed)
    longest = max(len(w) for words in CLOSED_CLASSES.values() for w in words)
    return F.when(F.length(word) <= longest, closed).otherwise(rule)


def lemma(word: Column, pos: Column) -> Column:
    """Rule lemma of a lower-case word: plural and verb endings fall away."""
    return (
        F.when(pos == "NNS", F.regexp_replace(word, "s$", ""))
        .when(pos == "VBD", F.regexp_replace(word, "(ed|ing)$", ""))
        .otherwise(word)
    )


def span_annotate(sentences: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tokens`` of ``SPAN_TOKEN_SCHEMA``: :func:`rule_annotate` for words, numbers, punctuation and symbols, with places.

    ``substring(text, begin + 1, end - begin)`` is the token. Numbers are ``CD``, what ends a sentence is ``.``, other characters
    ``SYM``; with the full stop as a token, patterns end at it. Empty texts have no tokens, a null text has null.
    """
    words = F.regexp_extract_all(F.col(text), F.lit(TOKEN), 0)
    gaps = F.split(text, TOKEN, -1)

    def all_tags(word: Column) -> Column:
        ends = F.when(word.isin(".", "!", "?"), ".")
        return ends.when(word.rlike(r"^\p{N}"), "CD").when(word.rlike(r"^[^\p{L}\p{M}]"), "SYM").otherwise(tag(word))

    # before a token stand all gaps up to its own and all tokens up to the one before
    def placed(ws: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(ws)), ws, lambda g, w: F.struct(F.length(g).alias("gap"), F.length(w).alias("long")))
        return bound(
            steps,
            lambda st: bound(
                running_starts(F.transform(st, lambda x: x["gap"] + x["long"])),
                lambda starts: F.zip_with(st, starts, lambda x, at: (at + x["gap"])),
            ),
        )

    spans = bound(words, lambda ws: F.arrays_zip(ws.alias("text"), placed(ws).alias("begin")))
    lowered = F.transform(spans, lambda t: F.struct(t["text"].alias("text"), F.lower(t["text"]).alias("low"), t["begin"].alias("begin")))
    tagged = F.transform(lowered, lambda t: t.withField("pos", all_tags(t["low"])))
    tokens = bound(
        tagged,
        lambda ts: F.transform(
            ts,
            lambda t, at: _chained(t, at, F.size(ts))
            .withField("begin", t["begin"])
            .withField("end", t["begin"] + F.length(t["text"])),
        ),
    )
    return with_column_once(sentences, "tokens", tokens.cast(SPAN_TOKEN_SCHEMA))


def _chained(tagged: Column, at: Column, count: Column) -> Column:
    """A token that hangs on the next one; the last one is the root."""
    last = at + 1 == count
    return F.struct(
        (at + 1).alias("id"),
        tagged["text"].alias("text"),
        lemma(tagged["low"], tagged["pos"]).alias("lemma"),
        tagged["pos"].alias("pos"),
        F.when(last, F.lit(0)).otherwise(at + 2).alias("head"),
        F.when(last, F.lit("ROOT")).otherwise(F.lit("next")).alias("dep"),
    )


def rule_annotate(sentences: DataFrame, text: str = "text") -> DataFrame:
    """Add ``tokens`` by rules alone: letters make tokens, each token hangs on
    the next one and the last one is the root.

    Column expressions only, so it works row by row, also on a stream.
    """
    words = F.filter(F.split(text, NOT_LETTERS), lambda w: w != "")
    lowered = F.transform(words, lambda w: F.struct(w.alias("text"), F.lower(w).alias("low")))
    tagged = F.transform(
        lowered, lambda w: F.struct(w["text"].alias("text"), w["low"].alias("low"), tag(w["low"]).alias("pos"))
    )
    # transforming a one-element array binds its element to a name
    tokens = F.transform(
        F.array(tagged), lambda ts: F.transform(ts, lambda t, i: _chained(t, i, F.size(ts)))
    )[0]
    return with_column_once(sentences, "tokens", tokens.cast(TOKEN_SCHEMA))


def annotate(sentences: DataFrame, annotator: Callable[[Column], Column], text: str = "text") -> DataFrame:
    """Add ``tokens`` by a user annotator.

    ``annotator`` takes the text column and returns a column of
    ``TOKEN_SCHEMA``; for a statistical model it is an iterator pandas UDF
    that loads the model once per worker.
    """
    return with_column_once(sentences, "tokens", annotator(F.col(text)).cast(TOKEN_SCHEMA))
