"""The chained plan: from documents or parses to scored contexts and vectors."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.annotate import dedup_sentences, rule_annotate, split_sentences, spread
from ..operators.association import association_scores, jobim_rotate, prune_contexts
from ..operators.counts import frequencies, pair_dictionary, pattern_dictionary
from ..operators.pairs import filter_thesaurus, subcorpus
from ..operators.patterns import sentence_patterns, subtree_patterns
from ..operators.vectors import context_vectors
from .storage import materialise


@dataclass
class Mined:
    """Results of :func:`mine`; the large inputs of several results are stored tables."""

    features: DataFrame
    pairs: DataFrame
    patterns: DataFrame
    frequencies: dict[str, DataFrame]
    contexts: DataFrame
    contexts_flipped: DataFrame
    vectors: DataFrame
    vectors_flipped: DataFrame


def parse_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct annotated sentences ``(sid, text, tokens)`` of documents, stored."""
    sentences = split_sentences(docs, doc_id, text).select(
        (F.col(doc_id) * F.lit(1 << 24) + F.col("pos")).alias("sid"), "text"
    )
    return materialise(rule_annotate(spread(dedup_sentences(sentences))), "parses")


def mine(
    parses: DataFrame,
    thesaurus: DataFrame | None = None,
    top_expansions: int = 50,
    max_tokens: int = 6,
    min_patterns: int = 2,
    min_pairs: int = 3,
    max_contexts: int = 1000,
) -> Mined:
    """Features, dictionaries, frequencies, pruned contexts and vectors of parsed sentences.

    With a ``thesaurus`` only its pairs are looked for; without one all noun
    pairs of a sentence are.
    """
    if thesaurus is None:
        found = sentence_patterns(parses, max_tokens=max_tokens)
    else:
        wanted = filter_thesaurus(thesaurus, top_expansions).selectExpr("target as noun1", "expansion as noun2")
        found = subtree_patterns(subcorpus(parses, wanted, counted=True), max_tokens=max_tokens)
    features = materialise(found, "features")
    jobim = materialise(jobim_rotate(features), "jobim")
    flipped = jobim.selectExpr("bim as jo", "jo as bim", "cnt")
    contexts = materialise(prune_contexts(association_scores(jobim), max_contexts), "contexts")
    contexts_flipped = materialise(prune_contexts(association_scores(flipped), max_contexts), "contexts")
    return Mined(
        features,
        pair_dictionary(features, 0, min_patterns),
        pattern_dictionary(features, 0, min_pairs),
        frequencies(features),
        contexts,
        contexts_flipped,
        context_vectors(contexts, "lmi"),
        context_vectors(contexts_flipped, "lmi"),
    )
