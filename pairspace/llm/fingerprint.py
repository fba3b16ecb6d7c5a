"""Order-independent document fingerprints by a homomorphic multiset hash [native].

The fingerprint of a text is a sum of wide vectors hashed from its paragraphs,
modulo 2**31 in each place, so paragraphs can be added or taken out
without the rest of the text and in any order. A vector has two parts:

* ``digest``: places hashed from the whole paragraph; they decide equality;
* ``lanes``: for each three-word piece of the paragraph one random bit per place.
  Twice a lane less the number of pieces is a random projection of the multiset of
  pieces, so the cosine between two projections estimates how much two texts share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairspace.plans.storage import materialise

from .rows import col

DIGEST_HASHES = 4
LANE_HASHES = 2
LANES = 64 * LANE_HASHES
# two counters of 32 bits in each sum
TWO_BITS = 0x1_0000_0001
LOW = 0xFFFF_FFFF
PLACE = 1 << 31
# a word and up to two that follow it, from each word on
PIECE = r"(?<!\S)(?=(\S+(?:\s+\S+){0,2}))"


def fingerprint(texts: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """``*keys, fingerprint``: the sum over all texts of a key, as ``digest, lanes, pieces``.

    Paragraphs are lines; empty ones, empty texts and null texts add nothing, so
    an empty text has a fingerprint of zeros. A repeated row counts again. If the input
    is already divided by (some of) ``keys``, nothing is shuffled; otherwise one row of
    sums per key and task is.
    """
    paragraphs = texts.select(*keys, F.explode_outer(F.split(text, "\n")).alias("_paragraph"))
    # the paragraph itself comes first, its pieces follow
    parts = F.concat(F.array("_paragraph"), F.regexp_extract_all("_paragraph", F.lit(PIECE), F.lit(1)))
    items = paragraphs.select(*keys, F.posexplode_outer(parts).alias("_at", "_part"))
    whole, said = F.col("_at") == 0, F.length("_part") > 0
    hashed = items.select(
        *keys,
        *[F.when(whole & said, F.xxhash64(F.lit(i), "_part")).alias(f"_d{i}") for i in range(DIGEST_HASHES)],
        *[F.when(~whole, F.xxhash64(F.lit(100 + i), "_part")).alias(f"_h{i}") for i in range(LANE_HASHES)],
    )
    halves = [
        F.sum(half).alias(f"_d{i}{side}")
        for i in range(DIGEST_HASHES)
        for side, half in (("a", F.col(f"_d{i}").bitwiseAND(F.lit(LOW))), ("b", F.shiftrightunsigned(F.col(f"_d{i}"), 32)))
    ]
    counters = [
        F.sum(F.shiftrightunsigned(F.col(f"_h{i}"), s).bitwiseAND(F.lit(TWO_BITS))).alias(f"_c{i}_{s}")
        for i in range(LANE_HASHES)
        for s in range(32)
    ]
    sums = hashed.groupBy(*keys).agg(*halves, *counters, F.count("_h0").alias("_pieces"))
    place = lambda c: F.coalesce(F.pmod(c, F.lit(PLACE)), F.lit(0)).cast("int")
    digest = [place(F.col(f"_d{i}{side}")) for i in range(DIGEST_HASHES) for side in "ab"]
    lanes = [
        place(lane)
        for i in range(LANE_HASHES)
        for s in range(32)
        for lane in (F.col(f"_c{i}_{s}").bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(F.col(f"_c{i}_{s}"), 32))
    ]
    return sums.select(
        *keys, F.struct(F.array(*digest).alias("digest"), F.array(*lanes).alias("lanes"), F.col("_pieces").alias("pieces")).alias("fingerprint")
    )


def add(one: Column, other: Column, sign: int = 1) -> Column:
    """The fingerprint after inserting (``sign=1``) or deleting (``-1``) the paragraphs of ``other``."""

    def places(name: str) -> Column:
        return F.zip_with(one[name], other[name], lambda x, y: F.pmod(x.cast("bigint") + y * sign, F.lit(PLACE)).cast("int"))

    return F.struct(
        places("digest").alias("digest"),
        places("lanes").alias("lanes"),
        F.pmod(one["pieces"] + other["pieces"] * sign, F.lit(PLACE)).alias("pieces"),
    )


def likeness(one: Column, other: Column) -> Column:
    """0 to 1: equal fingerprints give 1, else the cosine of the projections, not below 0.

    The standard error is about ``1 / sqrt(LANES)``. A text without words is like its equals only.
    """

    def projected(x: Column) -> Column:
        return F.transform(x["lanes"], lambda c: c.cast("double") * 2 - x["pieces"])

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    p, q = projected(one), projected(other)
    scale = F.sqrt(dot(p, p) * dot(q, q))
    cosine = F.when(scale > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(p, q) / scale))).otherwise(F.lit(0.0))
    return F.when(one == other, F.lit(1.0)).otherwise(cosine)


def as_text(print_: Column) -> Column:
    """The fingerprint as hex digits, eight for each place."""
    places = F.concat(print_["digest"], print_["lanes"], F.array(print_["pieces"].cast("int")))
    return F.array_join(F.transform(places, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def edit_fingerprints(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, one row per document.

    The edited text replaces the last ``n_chars div 2`` code points by the
    first as many (or all) of the next document, in ascending ``key``; after the last
    comes the first. Returns ``key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next``.

    A null text is an empty one. Rows that repeat key and text are one document;
    rows of one key with different texts are documents in the order of a hash of their text, and
    null keys come first. A table of one document is its own next. An empty table gives an empty result.

    Only keys are sorted: the order is built from keys and lengths, stored in key ranges; texts are shuffled
    once by key, and the beginnings that go to the document before once more.
    """
    said = F.coalesce(col(text), F.lit(""))
    # one key that is never null, so that joins, windows and sums agree on how rows are divided
    doc = F.struct(col(key).alias("id"), F.xxhash64(said).alias("a")).cast(f"struct<id:{dict(docs.dtypes)[key]},a:bigint>")
    rows = docs.select(doc.alias("doc"), said.alias("text"))
    order = materialise(
        rows.select("doc", F.length("text").cast("bigint").alias("n")).distinct()
        .repartitionByRange("doc").withColumn("slice", F.spark_partition_id()),
        "fingerprint-order",
    )
    item = F.struct("doc", "n")
    # one row per slice, whatever the number of documents
    ends = order.groupBy("slice").agg(F.max(item).alias("last"))
    by_slice = Window.orderBy("slice")
    final = F.last("last").over(by_slice.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    before = ends.select("slice", F.coalesce(F.lag("last").over(by_slice), final).alias("ended"))
    in_slice = Window.partitionBy("slice").orderBy("doc")
    placed = order.withColumn("lagged", F.lag(item).over(in_slice)).join(F.broadcast(before), "slice")
    placed = placed.select("doc", "n", F.coalesce("lagged", "ended").alias("prev"))

    base = rows.join(placed, "doc")
    once = Window.partitionBy("doc").orderBy(F.lit(0))
    base = base.withColumn("copy", F.row_number().over(once)).filter("copy = 1").drop("copy")
    begun = base.select(
        F.col("prev.doc").alias("doc"),
        F.col("doc").alias("next"),
        F.substring("text", F.lit(1), (F.col("prev.n") / 2).cast("int")).alias("begun"),
    )
    both = base.join(begun, "doc")
    half = (F.col("n") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n") - half).cast("int")), "begun")
    both = both.select(
        "doc", "n", "next",
        F.explode(F.array(F.struct(F.lit(0).alias("which"), "text"), F.struct(F.lit(1).alias("which"), edited.alias("text")))).alias("v"),
    )
    sha = F.when(F.col("v.which") == 1, F.sha2(F.encode("v.text", "UTF-8"), 256))
    texts = both.select("doc", "n", "next", F.col("v.which").alias("which"), sha.alias("sha"), F.col("v.text").alias("text"))
    summed = fingerprint(texts, ["doc", "which", "n", "next", "sha"], "text")
    pick = lambda which, value: F.first(F.when(F.col("which") == which, F.col(value)), ignorenulls=True)
    prints = materialise(
        summed.groupBy("doc").agg(
            F.first("n").alias("n"),
            F.first("next").alias("next"),
            pick(1, "sha").alias("sha"),
            pick(0, "fingerprint").alias("own"),
            pick(1, "fingerprint").alias("edited"),
        ),
        "fingerprints",
    )
    joined = prints.join(prints.select(F.col("doc").alias("next"), F.col("own").alias("following")), "next")
    return joined.select(
        F.col("doc.id").alias(key),
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited")).alias("near_edited"),
        likeness(F.col("own"), F.col("following")).alias("near_next"),
    )
