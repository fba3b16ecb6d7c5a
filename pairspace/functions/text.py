"""Column functions on words, tagged words and raw text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that XML 1.0 does not allow.
NOT_XML = r"[\x00-\x08\x0B\x0C\x0E-\x1F\uFFFE\uFFFF]"
ASTRAL = r"[\x{10000}-\x{10FFFF}]"

# What counts as a common noun in a thesaurus, and as a funny word.
COMMON_NOUN = r"^(?:[a-zA-Z][\S]+#NNS?)$"
FUNNY = r"[0-9.+@]"
NOT_PAIR_NAME = r"[^a-zA-Z:@]"


def sanitize(text: Column) -> Column:
    """Replace every character that XML does not allow by a blank.

    A character beyond the basic plane counts as two, one per UTF-16 unit.
    """
    return F.regexp_replace(F.regexp_replace(text, ASTRAL, "  "), NOT_XML, " ")


def is_tagged_common_noun(word: Column) -> Column:
    """``dog#NN`` or ``dogs#NNS``, at least two characters before the tag."""
    return word.rlike(COMMON_NOUN)


def strip_tag(word: Column) -> Column:
    """The part before the last ``#``, null when there is none."""
    return F.nullif(F.regexp_extract(word, r"^(.*)#.*$", 1), F.lit(""))


def is_plain_word(word: Column) -> Column:
    return ~word.rlike(FUNNY)


def is_pair_name(name: Column) -> Column:
    return ~name.rlike(NOT_PAIR_NAME)


def pair_text(first: Column, second: Column) -> Column:
    """``(first,second)``"""
    return F.concat(F.lit("("), first, F.lit(","), second, F.lit(")"))


def pair_name_to_text(name: Column) -> Column:
    """``a::@::b`` as ``(a,b)``; a name without the separator stays as it is."""
    parts = F.split(name, "::@::")
    return F.when(F.size(parts) > 1, pair_text(parts[0], parts[1])).otherwise(name)


def parse_bag(text: Column) -> Column:
    """``{(627,53.0),(501,72.3)}`` as an array of ``(idx, value)`` structs."""
    entries = F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), 1)
    return F.transform(
        entries,
        lambda e: F.struct(
            F.split(e, ",")[0].try_cast("bigint").alias("idx"),
            F.split(e, ",")[1].try_cast("double").alias("value"),
        ),
    )


def format_bag(entries: Column) -> Column:
    """The text form that :func:`parse_bag` reads."""
    return F.concat(
        F.lit("{"),
        F.array_join(F.transform(entries, lambda e: F.concat(F.lit("("), e["idx"], F.lit(","), e["value"], F.lit(")"))), ","),
        F.lit("}"),
    )


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` where ``value`` is computed once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def running_starts(lengths: Column, block: int = 64) -> Column:
    """For an array of integers the sums of what stands before each element.

    An array grows by copying; so sums run within blocks, and from block to block, which keeps long arrays cheap.
    """

    def sums(values: Column, first: Column) -> Column:
        return F.aggregate(values, F.array(first), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        return bound(
            sums(totals, F.lit(0)),
            lambda offsets: F.flatten(F.transform(blocks, lambda b, k: F.slice(sums(b, offsets[k]), F.lit(1), F.size(b)))),
        )

    def in_blocks(values: Column) -> Column:
        last = F.greatest(F.size(values) - 1, F.lit(0))
        starts = F.sequence(F.lit(0), F.floor(last / block).cast("int"))
        return bound(F.transform(starts, lambda k: F.slice(values, k * block + 1, F.lit(block))), joined)

    return bound(lengths, in_blocks)
