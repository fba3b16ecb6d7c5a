"""Parsed corpora: the vertical format and six-column dependency rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import bound, running_starts

OFFSET_BLOCK = 16

# Sentence end, the mark that joins the token lines of a
# sentence, and the lines that carry no token.
SENTENCE_CLOSE = "</s>"
TOKEN_MARK = "\t:::::\t"
MARKUP_LINE = r'^(<text id="ukwac:.*|<s>|</text>|</s>)?$'


def read_vertical(spark: SparkSession, path: str) -> DataFrame:
    """One row per sentence of a vertical file, split at the closing tag while reading; lines may end in either way."""
    return vertical_to_sentences(spark.read.option("lineSep", SENTENCE_CLOSE).text(path))


def vertical_to_sentences(chunks: DataFrame, col: str = "value") -> DataFrame:
    """``(parse)``: the token lines of each sentence, joined by ``TOKEN_MARK``.

    ``chunks`` holds the text between two sentence ends. Text and sentence
    tags fall away; a chunk without tokens gives no row.
    """
    lines = F.filter(F.split(col, "\r?\n"), lambda line: ~line.rlike(MARKUP_LINE))
    return chunks.select(F.array_join(lines, TOKEN_MARK).alias("parse")).filter(F.col("parse") != "")


def parse_conll(parse: Column) -> Column:
    """``struct<text, tokens>`` from joined six-column token lines, else null.

    The columns are token, lemma, tag, id, head and relation. One line of
    another width rejects the sentence. The text is the tokens joined by
    blanks, ``begin`` and ``end`` are places in it.
    """
    rows = F.transform(F.split(parse, TOKEN_MARK), lambda line: F.split(line, "\t"))

    def tokens(rs: Column, starts: Column) -> Column:
        def token(r: Column, i: Column) -> Column:
            begin = F.get(starts, i)
            return F.struct(
                r[3].try_cast("int").alias("id"),
                begin.alias("begin"),
                (begin + F.length(r[0])).alias("end"),
                r[0].alias("text"),
                r[1].alias("lemma"),
                r[2].alias("pos"),
                r[4].try_cast("int").alias("head"),
                r[5].alias("dep"),
            )

        return F.transform(rs, token)

    def with_offsets(rs: Column, forms: Column) -> Column:
        # before a token stand the others and a blank behind each
        return bound(running_starts(F.transform(forms, lambda f: F.length(f) + 1), OFFSET_BLOCK), lambda starts: tokens(rs, starts))

    def annotated(rs: Column) -> Column:
        whole = F.forall(rs, lambda r: F.size(r) == 6)
        return F.when(
            whole,
            F.transform(
                F.array(F.transform(rs, lambda r: r[0])),
                lambda forms: F.struct(F.array_join(forms, " ").alias("text"), with_offsets(rs, forms).alias("tokens")),
            )[0],
        )

    # transforming a one-element array binds its element to a name
    return F.transform(F.array(rows), annotated)[0]


def conll_parses(sentences: DataFrame, col: str = "parse") -> DataFrame:
    """Add ``text`` and ``tokens``; both are null for a rejected sentence."""
    kept = [c for c in sentences.columns if c != col]
    # exploded so that the parse is built once, whatever is filtered later
    return sentences.select(*kept, F.explode(F.array(parse_conll(F.col(col)))).alias("_p")).select(
        *kept, "_p.text", "_p.tokens"
    )


def dependency_edges(parses: DataFrame) -> DataFrame:
    """``(sid, head, dependent, dep)``; the root has no edge."""
    return (
        parses.select("sid", F.explode("tokens").alias("t"))
        .filter((F.col("t.dep") != "ROOT") & (F.col("t.head") > 0))
        .select("sid", "t.head", F.col("t.id").alias("dependent"), "t.dep")
    )
