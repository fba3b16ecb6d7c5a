"""Multiple-choice analogy questions in their text format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import pair_text
from ..plans.numbering import dense_ids
from .ordered import numbered_records

# Beginnings of lines that belong to no question, and the tag
# of questions that ask for a noun pair.
BOILERPLATE = r"^(\r\n|#|ML:|KS type|190)"
NOUN_NOUN = "n:n"
LINES_PER_QUESTION = 7
BLOCK_END = "\r\n\r\n"


def read_question_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``(block_no, value)``, one row per blank-line separated block, numbered in the order of the files and in them."""
    return numbered_records(spark, path, BLOCK_END, "block_no")


def mcq_clean(blocks: DataFrame) -> DataFrame:
    """``(qid, variant, question, answers, solution)`` from blocks ``(block_no, value)``.

    A question takes seven lines: the pair with its tag, five answer pairs
    and the letter of the solution. Only noun pairs are asked; they are
    numbered in block order. Variant 1 has all pairs inverted.
    """
    lines = F.filter(F.split("value", "\r?\n"), lambda line: (line != "") & ~line.rlike(BOILERPLATE))
    groups = blocks.select("block_no", lines.alias("lines")).select(
        "block_no",
        "lines",
        F.explode(F.expr(f"if(size(lines) < {LINES_PER_QUESTION}, cast(array() as array<int>), sequence(0, size(lines) - {LINES_PER_QUESTION}, {LINES_PER_QUESTION}))")).alias("at"),
    )
    asked = groups.select("block_no", "at", F.slice("lines", F.col("at") + 1, F.lit(LINES_PER_QUESTION)).alias("q")).filter(
        F.col("q")[0].endswith(NOUN_NOUN)
    )
    numbered = dense_ids(asked, ["block_no", "at"], "qid")

    def pair(line, flip):
        words = F.split(line, " ")
        return pair_text(words[1], words[0]) if flip else pair_text(words[0], words[1])

    def variant(no, flip):
        return F.struct(
            F.lit(no).alias("variant"),
            pair(F.col("q")[0], flip).alias("question"),
            F.transform(F.slice("q", 2, 5), lambda line: pair(line, flip)).alias("answers"),
        )

    return numbered.select(
        "qid",
        (F.ascii(F.trim(F.col("q")[6])) - 97).alias("solution"),
        F.explode(F.array(variant(0, False), variant(1, True))).alias("v"),
    ).select("qid", "v.variant", "v.question", "v.answers", "solution")
