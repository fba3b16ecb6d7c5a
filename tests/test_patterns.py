import itertools
import random
import re
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairspace.operators.annotate import TOKEN_SCHEMA, annotate, dedup_sentences, rule_annotate, sentence_spans, span_annotate, split_sentences
from pairspace.operators.pairs import filter_thesaurus, noun_pairs, pair_sentences, subcorpus, subcorpus_pairs
from pairspace.operators.patterns import (
    entity_head,
    sentence_patterns,
    shortest_path_patterns,
    span_patterns,
    subtree_patterns,
)
from pairspace.plans.storage import materialise_by

PARSES = "sid long, text string, tokens " + TOKEN_SCHEMA
PAIRED = "noun1 string, noun2 string, " + PARSES

DOG = [
    (1, "The", "the", "DT", 2, "NMOD"),
    (2, "dog", "dog", "NN", 3, "SBJ"),
    (3, "chased", "chase", "VBD", 0, "ROOT"),
    (4, "a", "a", "DT", 6, "NMOD"),
    (5, "small", "small", "JJ", 6, "NMOD"),
    (6, "cat", "cat", "NN", 3, "OBJ"),
    (7, ".", ".", "SENT", 3, "P"),
]
CATS = [
    (1, "Cats", "cat", "NNS", 4, "nsubj"),
    (2, "and", "and", "CC", 1, "cc"),
    (3, "dogs", "dog", "NNS", 1, "conj"),
    (4, "sleep", "sleep", "VBP", 0, "ROOT"),
    (5, ".", ".", ".", 4, "punct"),
]


def text_of(tokens):
    return " ".join(t[1] for t in tokens)


def paired(spark, *items):
    return spark.createDataFrame([(a, b, i, text_of(t), t) for i, (a, b, t) in enumerate(items)], PAIRED)


def patterns(df):
    return sorted(r.pattern for r in df.collect())


def test_subtrees_of_a_transitive_sentence(spark):
    df = paired(spark, ("dog", "cat", DOG))
    expected = [
        "X chased Y", "X chased a Y", "X chased a small Y", "X chased small Y",
        "the X chased Y", "the X chased a Y", "the X chased a small Y", "the X chased small Y",
    ]
    assert patterns(subtree_patterns(df)) == expected
    assert len(patterns(subtree_patterns(df, max_tokens=5))) == 7
    assert len(patterns(subtree_patterns(df, max_tokens=4))) == 4
    assert patterns(sentence_patterns(df)) == expected


def test_conjunction_adds_and_once(spark):
    assert patterns(subtree_patterns(paired(spark, ("cat", "dog", CATS)))) == ["X and Y", "X and Y sleep"]


def test_gates(spark):
    one_noun = [(1, "dog", "dog", "NN", 2, "SBJ"), (2, "ran", "run", "VBD", 0, "ROOT"), (3, "off", "off", "RP", 2, "P")]
    capital = [t if t[0] != 2 else (2, "Dog", "Dog", "NN", 3, "SBJ") for t in DOG]
    thrice = DOG[:6] + [(7, "dog", "dog", "NN", 3, "OBJ")]
    df = paired(
        spark, ("dog", "cat", one_noun), ("dog", "cat", capital), ("dog", "cat", thrice)
    )
    assert patterns(subtree_patterns(df)) == []


def test_selections(spark):
    df = paired(spark, ("dog", "cat", DOG))
    eight = patterns(subtree_patterns(df))
    assert len(eight) == 8
    assert patterns(subtree_patterns(df, selection="COMMONNOUN")) == eight
    assert patterns(subtree_patterns(df, selection="PROPERNOUN")) == []
    with pytest.raises(ValueError):
        subtree_patterns(df, selection="NAMEDENTITY")
    spans = F.array(F.struct(F.lit(2).alias("first"), F.lit(2).alias("last")), F.struct(F.lit(6).alias("first"), F.lit(6).alias("last")))
    assert patterns(subtree_patterns(df.withColumn("entities", spans), selection="NAMEDENTITY")) == eight
    assert patterns(subtree_patterns(df.withColumn("entities", F.slice(spans, 1, 1)), selection="NAMEDENTITY")) == []


def test_long_sentence_is_read_whole(spark):
    """500 tokens with branches; all sets are within five steps of the pair, where brute force can look."""
    at = 300
    tokens = [(i, f"w{i}", f"w{i}", "JJ", i - 1 if i % 3 else max(0, i - 2), "m") for i in range(1, 501)]
    tokens[at] = (at + 1, "dog", "dog", "NN", at, "SBJ")
    tokens[at + 2] = (at + 3, "cat", "cat", "NN", at + 2, "OBJ")
    near = [t for t in tokens if abs(t[0] - at) <= 14]
    ids = {t[0] for t in near}
    cut = [t if t[4] in ids else (*t[:4], 0, t[5]) for t in near]
    got = Counter(r.pattern for r in subtree_patterns(paired(spark, ("dog", "cat", tokens)), max_tokens=5).collect())
    assert got == brute_force(cut, "dog", "cat", max_tokens=5) and sum(got.values()) > 5


def test_words_are_quoted(spark):
    odd = [(1, "a+", "a+", "NN", 2, "SBJ"), (2, "hits", "hit", "VBZ", 0, "ROOT"), (3, "b", "b", "NN", 2, "OBJ")]
    assert patterns(subtree_patterns(paired(spark, ("a+", "b", odd)))) == ["X hits Y"]


def brute_force(tokens, noun1, noun2, max_tokens=6):
    """All subsets, tested one by one by the rule."""
    if sum(t[3] in ("NN", "NNS") for t in tokens) < 2:
        return Counter()
    ends = [t[0] for t in tokens if t[2] in (noun1, noun2)]
    if len(ends) != 2:
        return Counter()
    by_id = {t[0]: t for t in tokens}
    edges = [(t[0], t[4], t[5]) for t in tokens if t[4]]
    in_graph = {e[0] for e in edges} | {e[1] for e in edges}
    found = set()
    for k in range(3, max_tokens + 1):
        for combo in itertools.combinations(by_id, k):
            if not set(ends) <= set(combo):
                continue
            inside = set(combo) & in_graph
            if not set(ends) <= inside:
                continue
            reached, queue = {ends[0]}, [ends[0]]
            while queue:
                at = queue.pop()
                for a, b, _ in edges:
                    for u, w in ((a, b), (b, a)):
                        if u == at and w in inside and w not in reached:
                            reached.add(w)
                            queue.append(w)
            if reached != inside:
                continue
            full = set(inside)
            for a, b, dep in edges:
                if dep == "conj" and a in inside and b in inside:
                    full |= {i for i in range(min(a, b) + 1, max(a, b)) if by_id[i][1] == "and"}
            if len(full) < 3 or any(
                (by_id[i][3].startswith("N") and i not in ends) or by_id[i][1] == "." for i in full
            ):
                continue
            found.add(frozenset(full))
    result = Counter()
    for full in found:
        line = " ".join(by_id[i][1].lower() for i in sorted(full))
        for place, mark in zip(ends, "XY"):
            line = re.sub(rf"(?<!\w){re.escape(by_id[place][1].lower())}(?!\w)", mark, line)
        result[line] += 1
    return result


def random_tree(rng):
    n = rng.randint(3, 9)
    order = list(range(1, n + 1))
    rng.shuffle(order)
    heads = {order[0]: 0}
    for k, i in enumerate(order[1:], 1):
        heads[i] = rng.choice(order[:k]) if rng.random() > 0.08 else 0
    nouns = set(rng.sample(range(1, n + 1), rng.choice([2, 2, 2, 3])))
    tokens = []
    for i in range(1, n + 1):
        if i in nouns:
            word, pos = f"n{i}", "NN"
        else:
            word, pos = (("and", "CC") if rng.random() < 0.3 else (".", ".") if rng.random() < 0.05 else (f"v{i}", "VB"))
        dep = "ROOT" if heads[i] == 0 else rng.choice(["conj", "x", "y"])
        tokens.append((i, word, word, pos, heads[i], dep))
    first, second = sorted(nouns)[:2]
    return f"n{first}", f"n{second}", tokens


def test_subtrees_against_all_subsets(spark):
    rng = random.Random(11)
    trees = [random_tree(rng) for _ in range(400)]
    got = {}
    for r in subtree_patterns(paired(spark, *[(a, b, t) for a, b, t in trees]).withColumn("text", __import__("pyspark").sql.functions.col("sid").cast("string"))).collect():
        got.setdefault(int(r.sentence), Counter())[r.pattern] += 1
    for i, (a, b, tokens) in enumerate(trees):
        assert got.get(i, Counter()) == brute_force(tokens, a, b), tokens


def test_both_ways_to_patterns_agree(spark):
    rng = random.Random(5)
    trees = [random_tree(rng)[2] for _ in range(150)]
    parses = spark.createDataFrame([(i, text_of(t) + f" {i}", t) for i, t in enumerate(trees)], PARSES)
    pairs = noun_pairs(parses).join(parses, "sid")
    assert rows(subtree_patterns(pairs)) == rows(sentence_patterns(parses))


def test_shortest_path(spark):
    assert patterns(shortest_path_patterns(paired(spark, ("dog", "cat", DOG)))) == ["X chased Y"]
    assert patterns(shortest_path_patterns(paired(spark, ("cat", "dog", CATS)))) == ["X and Y"]
    held = [
        (1, "In", "in", "IN", 4, "prep"), (2, "house", "house", "NN", 1, "pobj"), (3, "the", "the", "DT", 5, "det"),
        (4, "sat", "sit", "VBD", 0, "ROOT"), (5, "cat", "cat", "NN", 2, "x"),
    ]
    # the governor of the first noun is not on the path
    assert patterns(shortest_path_patterns(paired(spark, ("house", "cat", held)))) == []
    with_word = held[:2] + [(3, "of", "of", "IN", 2, "prep"), (4, "sat", "sit", "VBD", 0, "ROOT"), (5, "cat", "cat", "NN", 3, "pobj")]
    assert patterns(shortest_path_patterns(paired(spark, ("house", "cat", with_word)))) == ["In X of Y"]


def test_span_patterns(spark):
    assert patterns(span_patterns(paired(spark, ("dog", "cat", DOG)))) == []
    held = [
        (1, "big", "big", "JJ", 5, "a"), (2, "dog", "dog", "NN", 5, "b"), (3, "house", "house", "NN", 5, "c"),
        (4, "cat", "cat", "NN", 5, "d"), (5, "left", "leave", "VBD", 0, "ROOT"),
    ]
    got = patterns(span_patterns(paired(spark, ("dog", "cat", held))))
    assert got == sorted(
        ["big X house Y left", "<adj> X <noun> Y left", " X  Y left", "X house Y left", "X <noun> Y left", "X  Y left"]
    )


def test_entity_head(spark):
    parses = spark.createDataFrame([(1, text_of(DOG), DOG)], PARSES)
    spans = spark.createDataFrame([(1, 1, 1, 2), (1, 2, 4, 6), (1, 3, 4, 5)], "sid long, span int, first int, last int")
    assert rows(entity_head(spans, parses), "span", "head") == [(1, 2), (2, 6), (3, 5)]


def test_sentences_and_rules(spark):
    docs = spark.createDataFrame([(1, "The dogs barked. A cat\nA cat")], "doc_id long, text string")
    split = split_sentences(docs).withColumnRenamed("pos", "sid")
    assert rows(dedup_sentences(split)) == [(0, "The dogs barked"), (1, "A cat")]
    tokens = {r.sid: [(t.text, t.lemma, t.pos, t.head, t.dep) for t in r.tokens] for r in rule_annotate(split).collect()}
    assert tokens[0] == [("The", "the", "DT", 2, "next"), ("dogs", "dog", "NNS", 3, "next"), ("barked", "bark", "VBD", 0, "ROOT")]


def test_tokens_with_places(spark):
    texts = ["  It cost 3.50 (net)! Höhe: 12 m\u00b2\n\n\U0001F600 ok", "", None, " \t\n", "...", "a" + " b.c" * 500]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = span_annotate(sentence_spans(docs)).collect()
    by_doc = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.pos)):
        whole = texts[r.doc_id]
        assert whole[r.begin : r.begin + len(r.text)] == r.text
        for t in r.tokens:
            assert r.text[t.begin : t.end] == t.text
            by_doc.setdefault(r.doc_id, []).append((t.text, t.pos))
    # everything visible is in a token
    assert all("".join(w for w, _ in by_doc.get(i, [])) == "".join((t or "").split()) for i, t in enumerate(texts))
    assert by_doc[0][:9] == [("It", "DT"), ("cost", "NN"), ("3", "CD"), (".", "."), ("50", "CD"), ("(", "SYM"), ("net", "NN"), (")", "SYM"), ("!", ".")]
    assert set(by_doc) == {0, 4, 5} and len(by_doc[5]) == 1501
    # the sentence as a whole: a full stop is a token that no pattern crosses
    parsed = span_annotate(spark.createDataFrame([(1, "dog of cat"), (2, "dog . cat"), (3, "dog, cat")], "sid int, text string"))
    assert rows(sentence_patterns(parsed), "pattern") == [("X , Y",), ("X of Y",)]


def test_user_annotator(spark):
    import pandas as pd
    from pyspark.sql import functions as F

    @F.pandas_udf(TOKEN_SCHEMA)
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(id=i + 1, text=w, lemma=w, pos="NN", head=0, dep="ROOT") for i, w in enumerate(t.split())])

    df = annotate(spark.createDataFrame([(1, "b a")], "sid long, text string"), words)
    assert rows(noun_pairs(df)) == [(1, "b", "a")]


def test_noun_pairs_keep_their_parts(spark):
    """Blocks of nouns are small beside their pairs: they are not put together into few tasks."""
    token = T.StructType([T.StructField(c, T.StringType()) for c in ("lemma", "pos")])
    schema = T.StructType([T.StructField("sid", T.LongType()), T.StructField("tokens", T.ArrayType(token))])
    pairs = noun_pairs(spark.createDataFrame([(i, [("a", "NN"), ("b", "NN")]) for i in range(200)], schema))
    assert pairs.count() == 200
    assert pairs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_noun_pairs_and_subcorpus(spark):
    many = [(i, f"w{i}", f"w{i}", "NN", 0, "ROOT") for i in range(1, 601)]
    parses = spark.createDataFrame([(1, text_of(DOG), DOG), (2, "long", many)], PARSES)
    pairs = noun_pairs(parses)
    assert pairs.filter("sid = 2").count() == 600 * 599 // 2 == pairs.filter("sid = 2").distinct().count()
    assert rows(pairs.filter("sid = 1")) == [(1, "dog", "cat")]
    wanted = spark.createDataFrame([("dog", "cat"), ("cat", "dog"), ("w1", "w600")], "noun1 string, noun2 string")
    assert rows(subcorpus(parses, wanted), "noun1", "noun2", "sid") == [("dog", "cat", 1), ("w1", "w600", 2)]


def test_noun_pairs_dealt_by_the_first(spark):
    """A sentence goes to the parts of its nouns; pairs are not shuffled, whatever is grouped by part and first noun."""
    rng = random.Random(7)
    sizes = [0, 1, 2, 3, 5, 8, 40]
    made = [(i, " ", [(k, "w", rng.choice(["Ox", "ox", "cow", "hen", "w", None]), rng.choice(["NN", "NNS", "DT"]), 0, "ROOT") for k in range(n)]) for i, n in enumerate(sizes)]
    parses = spark.createDataFrame([*made, (None, " ", made[-1][2]), (9, " ", None)], PARSES)
    pairs = noun_pairs(parses, by_first=True)
    assert rows(pairs, "sid", "noun1", "noun2") == rows(noun_pairs(parses)) and pairs.count() > 100
    told = pairs.groupBy("part", "noun1", "noun2").agg(F.count("*").alias("n")).groupBy("part", "noun1").agg(F.sum("n"), F.count("*"))
    assert rows(told.drop("part")) == rows(noun_pairs(parses).groupBy("noun1", "noun2").agg(F.count("*").alias("n")).groupBy("noun1").agg(F.sum("n"), F.count("*")))
    assert told._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def _drawn(spark, seed=3):
    """Sentences of few nouns and one long one, a sentence without id, and wanted pairs, one of them twice."""
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["ox", "cow", "hen", "of", "the", "is", "dogs"]) for _ in range(n)) for n in [2, 5, 7, 7, 8, 9, 60]] + ["ox is the cow", "cow ox is"]
    parses = rule_annotate(spark.createDataFrame([*enumerate(texts), (None, "ox of hen")], "sid long, text string"))
    pairs = [("ox", "cow"), ("cow", "ox"), ("hen", "hen"), ("dog", "ox"), ("dog", "ox"), (None, "ox"), ("ox", "absent")]
    return parses, spark.createDataFrame(pairs, "noun1 string, noun2 string")


def test_counted_pairs(spark):
    parses, wanted = _drawn(spark)
    every = noun_pairs(parses.filter("sid is not null")).join(wanted, ["noun1", "noun2"]).select("sid", "noun1", "noun2")
    assert rows(subcorpus_pairs(parses, wanted)) == rows(every)
    # a pair that is wanted twice comes twice
    counted = subcorpus_pairs(parses, wanted, counted=True)
    told = Counter()
    for r in counted.collect():
        told[r.sid, r.noun1, r.noun2] += r.times
    assert told == Counter(tuple(r) for r in every.collect()) and max(told.values()) > 20
    assert counted.count() < sum(told.values()) / 5


def test_patterns_of_a_counted_corpus(spark):
    parses, wanted = _drawn(spark)
    plain, counted = subcorpus(parses, wanted), subcorpus(parses, wanted, counted=True)
    for made in (subtree_patterns, shortest_path_patterns, span_patterns):
        assert rows(made(counted)) == rows(made(plain)) and made(plain).count() > 0
    assert rows(pair_sentences(counted).groupBy("noun1", "noun2", "text").agg(F.sum("times"))) == rows(pair_sentences(plain).groupBy("noun1", "noun2", "text").count())


def test_parses_stored_by_sentence_are_not_shuffled(spark):
    parses, wanted = _drawn(spark)
    stored = materialise_by(parses, "parses", "sid")
    assert rows(stored.select("sid", "text")) == rows(parses.select("sid", "text")) and stored.columns == parses.columns
    corpus = subcorpus(stored, wanted, counted=True)
    plan = corpus._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "tokens" in line]
    joined = stored.hint("merge").join(spark.range(20).withColumnRenamed("id", "sid"), "sid")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joined and "Bucketed: true" in joined
    assert rows(corpus.select("sid", "noun1", "noun2", "times")) == rows(subcorpus(parses, wanted, counted=True).select("sid", "noun1", "noun2", "times"))


def test_thesaurus_filter(spark):
    df = spark.createDataFrame(
        [
            ("dog#NN", "cat#NNS", 5.0), ("dog#NN", "puppy#NN", 7.0), ("dog#NN", "dog#NNS", 9.0), ("dog#NN", "a#NN", 4.0),
            ("dog#NN", "Cat2#NN", 3.0), ("dog#NNP", "cat#NN", 8.0), ("a#b#NN", "cat#NN", 1.0),
        ],
        "target string, expansion string, similarity double",
    )
    assert rows(filter_thesaurus(df, 1)) == [("a#b", "cat", 1.0), ("dog", "puppy", 7.0)]


def test_row_operators_accept_a_stream(spark, tmp_path):
    spark.createDataFrame([(1, "The dog saw a cat")], "sid long, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sid long, text string").parquet(str(tmp_path / "in"))
    query = sentence_patterns(rule_annotate(stream)).writeStream.format("memory").queryName("streamed").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("streamed").filter("noun1 = 'dog'").count() > 0


def test_a_sentence_of_many_thousand_tokens(spark):
    """On a chain a connected set is a run of tokens: count the runs that hold two nouns and nothing shut."""
    name = str.maketrans("0123456789", "abcfghjkmo")
    words = ["of" if i % 4 in (1, 2) and i % 7 else "w" + str(i).translate(name) for i in range(6_000)]
    nouns = [w != "of" for w in words]
    runs = sum(
        1 for at in range(len(words)) for size in range(3, 7) if at + size <= len(words) and sum(nouns[at : at + size]) == 2
    )
    parsed = rule_annotate(spark.createDataFrame([(1, " ".join(words))], "sid long, text string"))
    assert sentence_patterns(parsed).count() == runs > 3_000


def test_token_sets_are_no_chain_of_wide_rows(spark):
    """Paths and sets are lengthened in one pass, not by a row per step that carries the sentence along; two heads may name each other."""
    df = paired(spark, ("dog", "cat", DOG))
    plan = sentence_patterns(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 0 and plan.count("MapInArrow") == 1
    mutual = [(1, "dog", "dog", "NN", 2, "a"), (2, "sees", "see", "VB", 1, "b"), (3, "cat", "cat", "NN", 2, "c"), (4, "", "", None, None, None)]
    assert patterns(sentence_patterns(paired(spark, ("dog", "cat", mutual)))) == ["X sees Y"]


def test_the_path_between_near_tokens_of_a_very_long_chain(spark):
    """Climbing to the root of a chain of 40,000 tokens copied as many places for each of them."""
    chain = [(i, f"w{i}", f"w{i}", "NN" if i in (3, 5) else "IN", i + 1 if i < 40_000 else 0, "next") for i in range(1, 40_001)]
    apart = [(1, "dog", "dog", "NN", 0, "ROOT"), (2, "cat", "cat", "NN", 0, "ROOT")]
    assert patterns(shortest_path_patterns(paired(spark, ("w3", "w5", chain), ("dog", "cat", apart), (None, "w5", chain)))) == ["X w4 Y"]
