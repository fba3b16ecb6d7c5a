"""Noun pairs, the thesaurus filter and the subcorpus of wanted pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_plain_word, is_tagged_common_noun, strip_tag
from ..plans.once import with_column_once
from .counts import top_n

NOUN_TAGS = ("NN", "NNS")
PAIR_BLOCK = 256


def filter_thesaurus(pairs: DataFrame, n: int) -> DataFrame:
    """The ``n`` most similar expansions of each target among plain common nouns.

    ``pairs`` is ``(target, expansion, similarity)`` with ``#TAG`` suffixes.
    The tags fall away before the ranking, so singular and plural entries of
    one word compete under the same target and a pair may come twice.
    """
    nouns = pairs.filter(is_tagged_common_noun(F.col("target")) & is_tagged_common_noun(F.col("expansion")))
    words = nouns.select(
        strip_tag(F.col("target")).alias("target"), strip_tag(F.col("expansion")).alias("expansion"), "similarity"
    ).filter(
        (F.col("target") != F.col("expansion")) & is_plain_word(F.col("target")) & is_plain_word(F.col("expansion"))
    )
    return top_n(words, by=["target"], score="similarity", n=n, tie=["expansion"])


def nouns_of(tokens: Column, tags: Sequence[str] = NOUN_TAGS) -> Column:
    """Lower-cased lemmas of the nouns of a sentence, in text order."""
    return F.transform(F.filter(tokens, lambda t: t["pos"].isin(list(tags))), lambda t: F.lower(t["lemma"]))


def noun_pairs(parses: DataFrame, tags: Sequence[str] = NOUN_TAGS, spread: bool = True, by_first: bool = False) -> DataFrame:
    """``(sid, noun1, noun2)`` for all nouns ``i < j`` of each sentence.

    Equal lemmas stay, the inverse order is not produced, and a sentence with
    fewer than two nouns gives nothing. A sentence with ``n`` nouns gives
    ``n * (n - 1) / 2`` rows, so long sentences are cut into blocks of left
    nouns and, with ``spread``, the (still small) blocks are dealt out over
    the cluster before they are expanded, in as many parts as the session shuffles
    into: by their size, which says nothing of their pairs, they would be put together again.

    With ``by_first`` the pairs come with a column ``part`` that follows from ``noun1``, and are dealt out by it: a sentence goes once to each part that
    one of its nouns belongs to, and is paired there. So what is grouped by ``part``, ``noun1`` and more is not shuffled again, and the
    pairs themselves, far more than the nouns of long sentences, never are.
    """
    nouns = with_column_once(parses.select("sid", "tokens"), "nouns", nouns_of(F.col("tokens"), tags)).select("sid", "nouns")
    parts = int(parses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if by_first:
        return _dealt_by_first(nouns.filter(F.size("nouns") > 1), parts)
    blocks = nouns.filter(F.size("nouns") > 1).select(
        "sid", "nouns", F.explode(F.sequence(F.lit(0), F.size("nouns") - 2, F.lit(PAIR_BLOCK))).alias("start")
    )
    if spread:
        blocks = blocks.repartition(parts, "sid", "start")
    lefts = blocks.select(
        "sid", "nouns", F.col("start"), F.posexplode(F.slice("nouns", F.col("start") + 1, F.lit(PAIR_BLOCK))).alias("at", "noun1")
    )
    rest = F.slice("nouns", F.col("start") + F.col("at") + 2, F.size("nouns"))
    return lefts.select("sid", "noun1", F.explode(rest).alias("noun2"))


def _dealt_by_first(nouns: DataFrame, parts: int) -> DataFrame:
    """``(sid, part, noun1, noun2)`` of sentences' nouns, dealt out over ``parts`` by ``noun1``."""
    # a noun is told by itself in every task, so a null one has a part too
    owners = F.transform("nouns", lambda n: F.pmod(F.xxhash64(n), F.lit(parts)).cast("int"))
    owned = with_column_once(nouns, "owners", owners)
    # the last noun is the left one of no pair
    asked = owned.select("sid", "nouns", "owners", F.explode(F.array_distinct(F.slice("owners", F.lit(1), F.size("owners") - 1))).alias("part"))
    first = F.array_position("owners", F.col("part")).cast("int")
    sent = asked.select("sid", "part", F.slice("nouns", first, F.size("nouns")).alias("nouns")).repartitionById(parts, "part")
    lefts = sent.select("sid", "part", "nouns", F.posexplode("nouns").alias("at", "noun1"))
    mine = lefts.filter(F.pmod(F.xxhash64("noun1"), F.lit(parts)) == F.col("part"))
    return mine.select("sid", "part", "noun1", F.explode(F.slice("nouns", F.col("at") + 2, F.size("nouns"))).alias("noun2"))


def subcorpus_pairs(parses: DataFrame, wanted: DataFrame, tags: Sequence[str] = NOUN_TAGS, counted: bool = False) -> DataFrame:
    """The noun pairs that are wanted, ``(sid, noun1, noun2)``; repeats stay, or are told as ``times`` with ``counted``.

    Nouns are looked up before they are paired: only those that a wanted pair has at all leave the annotated sentence. They come together again
    by sentence, one element for each distinct noun and side with its places, and only distinct lefts and rights of one sentence are
    held against the wanted pairs. A common noun's partners, which are far more than the nouns of most sentences, are never listed.
    ``sid`` must tell sentences apart.
    """
    pairs = wanted.select("noun1", "noun2").filter("noun1 is not null and noun2 is not null")
    lefts = pairs.select(F.col("noun1").alias("noun"), F.lit(1).alias("side"))
    rights = pairs.select(F.col("noun2").alias("noun"), F.lit(2).alias("side"))
    sides = lefts.unionByName(rights).groupBy("noun").agg(F.bit_or("side").alias("sides"))
    nouns = with_column_once(parses.filter("sid is not null").select("sid", "tokens"), "nouns", nouns_of(F.col("tokens"), tags)).filter(F.size("nouns") > 1)
    known = nouns.select("sid", F.posexplode("nouns").alias("at", "noun")).join(sides, "noun")
    # all nouns of a sentence go to one task, and what follows stays there
    placed = known.repartition("sid").groupBy("sid", "noun", "sides").agg(F.collect_list("at").alias("places"))
    whole = placed.groupBy("sid").agg(F.collect_list(F.struct("noun", "sides", "places")).alias("nouns"))
    left = whole.select("sid", F.explode(F.expr("filter(nouns, x -> x.sides & 1 > 0)")).alias("l"), F.expr("filter(nouns, x -> x.sides & 2 > 0)").alias("rights"))
    met = left.select("sid", "l", F.explode("rights").alias("r")).select(
        "sid", F.col("l.noun").alias("noun1"), F.col("r.noun").alias("noun2"), F.col("l.places").alias("a"), F.col("r.places").alias("b")
    )
    later = F.expr("aggregate(a, 0L, (n, x) -> n + size(filter(b, y -> y > x)))")
    found = met.join(pairs, ["noun1", "noun2"]).select("sid", "noun1", "noun2", later.alias("times")).filter("times > 0")
    return found if counted else found.select("sid", "noun1", "noun2", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")


def subcorpus(parses: DataFrame, wanted: DataFrame, tags: Sequence[str] = NOUN_TAGS, counted: bool = False) -> DataFrame:
    """Wanted noun pairs with their parse, ``(noun1, noun2, sid, text, tokens)``.

    With ``counted`` a pair that a sentence holds several times is one row, and ``times`` tells how often: long sentences hold a pair many
    thousand times. Only sentence ids travel through the pair join; the heavy parse is
    attached afterwards, to the sentences that are left.
    """
    kept = ["noun1", "noun2", "sid", "text", "tokens", *(["times"] if counted else [])]
    return subcorpus_pairs(parses, wanted, tags, counted).join(parses.select("sid", "text", "tokens"), "sid").select(*kept)


def pair_sentences(corpus: DataFrame) -> DataFrame:
    """Pair and plain sentence, for reading; with ``times``, if the corpus is counted."""
    return corpus.select("noun1", "noun2", "text", *[c for c in ("times",) if c in corpus.columns])
