"""Operators that work row by row, against brute force and on the odd cases."""

import hashlib
import os
import random
import re

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from pairspace.llm import decontaminate, main_text, pieces, pii, toxicity

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LONG = "Wörter und words " * 20_000


def texts(spark, *values):
    """Rows with an id, a text, and columns whose names an operator might want for itself."""
    return spark.createDataFrame([(i, t, "mine") for i, t in enumerate(values)], "id long, text string, score string").withColumns(
        {"n_words": F.lit("x"), "piece_ids": F.lit("x"), "spans": F.lit("x"), "_hits": F.lit("x")}
    )


ODD = (None, "", " ", LONG, "same text here", "same text here")


def test_pieces_equal_the_library():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    encoder = pieces.Encoder(pieces.Vocabulary.load(MODEL), remembered=50)
    rng = random.Random(5)
    letters = "aàbcdeéßöñ .,\n\t01  门😀TheIng"
    said = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(2_000)]
    said += [" " * n + "foo" for n in range(40)] + ["a" * n for n in range(60)] + ["", LONG]
    got = encoder.encode(said)
    assert [g.tolist() for g in got] == model.encode(said)
    assert [pieces.decode(g, encoder.v) for g in got] == said


def test_unigram_viterbi_is_the_best_sum():
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -4.0, "▁a": -3.5, "ba": -3.0, "bab": -4.2}
    v = pieces.Vocabulary(pieces.UNIGRAM, [b""] * 8, {p: i for i, p in enumerate(scores)}, [*scores.values(), -9.0], [-1] * 256, 7).prepared()
    encoder = pieces.Encoder(v)
    encoder.learn(["abab", "aba", "babba", "b"])

    def best(s):
        if not s:
            return 0.0
        return max((scores[s[:k]] + best(s[k:]) for k in range(1, len(s) + 1) if s[:k] in scores), default=float("-inf"))

    import numpy as np

    for word, coded in encoder.words.items():
        assert abs(sum(v.scores[i] for i in np.frombuffer(coded, np.int32)) - best("▁" + word)) < 1e-9


def test_encode_rows(spark):
    done = pieces.encode_texts(texts(spark, *ODD), "text", MODEL)
    assert done.columns.count("piece_ids") == 1
    back = pieces.decode_ids(done, "piece_ids", MODEL).orderBy("id").collect()
    assert [r.decoded for r in back] == list(ODD)
    assert back[0].piece_ids is None and back[1].piece_ids == [] and back[4].piece_ids == back[5].piece_ids
    checked = pieces.check_round_trip(texts(spark, *ODD), "text", MODEL)
    assert [r.same for r in checked.orderBy("id").collect()] == [None, True, True, True, True, True]
    assert pieces.encode_texts(texts(spark).filter("id < 0"), "text", MODEL).count() == 0


ITEM = "one two three four five six seven eight nine ten eleven"


def brute_hits(text, items):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    words = lambda t: word.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    said, hit, found = words(text), set(), set()
    for name, item in items:
        w = words(item)
        for k in range(max(1, len(w) - 9) if w else 0):
            window = w[k : k + 10]
            for i in range(len(said) - len(window) + 1):
                if said[i : i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(name)
    names = ",".join(sorted(found))
    return len(said), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)


def test_decontaminate(spark):
    items = [("7", ITEM), ("12", "Short, item!"), ("3", ITEM + " twelve"), ("9", None), ("8", "...")]
    bench = spark.createDataFrame([*items, (None, "same text here"), ("7", ITEM)], "item string, q string")
    said = [*ODD, "X " + ITEM.upper().replace(" ", " - ") + " twelve? short ITEM", "a short item a short  item", "short items", ITEM[4:]]
    said += [ITEM + " " + ITEM, "é" + ITEM, "two " + ITEM.replace("ten", "10")]
    for at_once in (1000, 1):
        done = decontaminate.find_benchmark(texts(spark, *said), "text", bench, "item", "q", windows_at_once=at_once)
        got = {r.id: r for r in done.collect()}
        for i, t in enumerate(said):
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute_hits(t, items), t
    spans = got[7].hit_spans
    assert [said[7][s.start : s.end] for s in spans] == ["short item", "short  item"]
    assert not any(r.contaminated for r in decontaminate.find_benchmark(texts(spark, *said), "text", bench.filter("false"), "item", "q").collect())


def test_personal_data_patterns():
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card = re.compile(r"[0-9]([\x20-]?[0-9])+")
    phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m.group())

    def brute(t):
        found = [(m.start(), m.end(), 0) for m in email.finditer(t)]
        found += [(m.start(), m.end(), 1) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        found += [(m.start(), m.end(), 2) for m in card.finditer(t) if 12 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
        found += [(m.start(), m.end(), 3) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]
        return sorted(found, key=lambda s: (s[0], s[2], s[1]))

    rng = random.Random(2)
    for _ in range(20_000):
        t = "".join(rng.choice("a1@.-+ ()9_é04") for _ in range(rng.randrange(45)))
        assert pii.base_spans(t) == brute(t), t
    assert pii.base_spans("4111 1111 1111 1111") == [(0, 19, 2)] and pii.base_spans("4111 1111 1111 1112") == []
    assert pii.base_spans("a" * 200_000 + "@" + "1" * 200_000) == []


def test_revealing_terms(spark):
    said = [f"met {chr(97 + i) * 4} zorbas{'' if i % 2 else 'x'} at joe@x.org {chr(98 + i) * 4} today" for i in range(12)]
    said += [f"met some other person {i} today" for i in range(300)] + [None, ""]
    docs = texts(spark, *said)
    terms = {r.term: r for r in pii.revealing_terms(docs, "text").collect()}
    assert set(terms) == {"zorbas", "zorbasx"} and terms["zorbas"].kind == 0
    for at_once in (1000, 1):
        done = {r.id: r for r in pii.sanitise(docs, "text", terms_at_once=at_once).collect()}
        assert done[1].spans == "term:9:15,email:19:28" and done[1].n_email == 1
        assert done[1].clean_text == "met bbbb  at [email] cccc today"
        assert done[20].spans == "" and done[312].clean_text is None and done[313].clean_text == ""
    # copies of one passage are one context and no evidence
    copies = texts(spark, *(["call yannis on joe@x.org now"] * 20 + said[12:]))
    assert pii.revealing_terms(copies, "text").count() == 0
    assert pii.sanitise(texts(spark).filter("id < 0"), "text").count() == 0


def test_revealing_terms_of_few_contexts(spark):
    other = ["met some other person today " * 50 for _ in range(300)]
    # one context in many copies, and one whose term is near by terms but far by letters
    said = ["reach quixano on solo@x.org soon"] * 20 + ["ask panza " + "." * 1000 + " duo@x.org"]
    terms = {r.term: r for r in pii.revealing_terms(texts(spark, *said, *other), "text").collect()}
    assert set(terms) == {"reach", "quixano", "soon", "ask", "panza"} and terms["quixano"].disclosure < 0.97
    # two entities share the term, which leaves each half of it
    both = ["reach quixano on solo@x.org soon", "reach quixano on more@x.org soon"]
    assert pii.revealing_terms(texts(spark, *both, *other), "text").count() == 0
    # occurrences inside an entity are none of the term's own
    inside = {r.term for r in pii.revealing_terms(texts(spark, "quixano: quixano@x.org", *["quixano@y.org"] * 9, *other), "text").collect()}
    assert inside == {"quixano"}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables")
def test_revealing_terms_of_a_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    assert pii.revealing_terms(docs, "text").count() == 134
    assert pii.sanitise(docs, "text").filter("spans like '%term:%'").count() > 0


def test_toxicity_grammar():
    reader = toxicity.Reader(toxicity.Lexicon({"oaf": 2.0}, {"idio": 3.0}))
    plain, targeted, negated, reported, threat = range(5)
    at = lambda t: {i for i, f in enumerate(reader.features(t)) if f > 0}
    assert at("what an idiot") == {plain} and at("You are an oaf.") == {targeted} and at("Idiot, you!") == {targeted}
    assert at("that is not an idiot") == {negated} and at("she said: nothing. idiots") == {plain}
    assert at('they wrote "idiot"') == {reported} and at("kill it") == set() and at("you I kill") == {threat}
    assert at("") == set() and at("the oafs") == set()
    composed = toxicity.grammar()
    assert len(composed.steps) == 4 * 3 * 2 and all(0 <= s < 24 for row in composed.steps for s in row)


def test_toxicity_learns_from_labels(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["ra", "ti", "mo", "ne", "sul"]) for _ in range(3))
    rows, labels = [], []
    for i in range(600):
        said = [word() for _ in range(30)]
        if i % 3 == 0:
            for _ in range(3):
                said.insert(rng.randrange(len(said)), "grumpf" + rng.choice(["", "el", "on"]))
        rows.append((i, " ".join(said)))
        labels.append((i, int(i % 3 == 0)))
    docs = spark.createDataFrame([*rows, (None, "grumpf"), (1000, None)], "id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([*labels, (None, 1), (1000, 1), (5, None)], "id long, toxic int"), "id", "text", "toxic")
    assert model.lexicon.weight("grumpfel") > 0 and model.lexicon.weight("ratimo") == 0
    done = {r.id: r for r in toxicity.score(texts(spark, *[t for _, t in rows], *ODD), "text", model).collect()}
    assert all(done[i].predicted == int(i % 3 == 0) for i in range(600))
    assert all(0 <= done[i].score < 0.5 for i in range(600, 606)) and done[604].score == done[605].score
    nothing = toxicity.learn(docs, spark.createDataFrame([], "id long, toxic int"), "id", "text", "toxic")
    assert {r.score for r in toxicity.score(texts(spark, *ODD), "text", nothing).collect()} == {0.5}


def test_toxicity_keeps_insults_that_clean_texts_quote(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["ra", "ti", "mo", "ne", "sul"]) for _ in range(3))
    said = [" ".join(word() for _ in range(10)) + (f" grumpf {word()}" if i % 3 == 0 or i == 1 else "") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "id long, toxic int")
    model = toxicity.learn(spark.createDataFrame(list(enumerate(said)), "id long, text string"), labels, "id", "text", "toxic", 10_000)
    assert model.lexicon.weight("grumpf") >= toxicity.MIN_WEIGHT and model.lexicon.weight("ratimo") == 0


def test_main_text(spark):
    trained = main_text.train(list(main_text.labelled_pages()))
    right = blocks = 0
    for page in main_text.labelled_pages(80, seed=11):
        found = main_text.leaf_blocks(page)
        labels = trained.decode(trained.scores(found))
        right += sum(bool(y) == b.is_main for b, y in zip(found, labels, strict=True))
        blocks += len(found)
    assert right / blocks > 0.99
    page = (
        "<html><body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>First  part<br>of\nit, and some more words here.<p>Second one "
        "goes on.</article><div class=ad>Buy this now.</div><footer>&copy; Us</footer><script>var a = '<p>no</p>'</script>"
    )
    pages = texts(spark, page, None, "", "<p", page)
    got = {r.id: (r.text, r.n_chars) for r in main_text.extract_main_text(pages.withColumnRenamed("text", "html"), "html", trained).collect()}
    article = "A & B\n\nFirst part of it, and some more words here.\n\nSecond one goes on."
    assert got == {0: (article, len(article)), 1: ("", 0), 2: ("", 0), 3: ("", 0), 4: (article, len(article))}


def test_head_without_end_tag_and_math():
    said = lambda page: [b.text for b in main_text.leaf_blocks(page)]
    body = "<p>One.<p>Two <math><mi>x</mi><mo>=</mo><mn>1</mn></math>."
    start = "<html><head><meta charset=utf-8><title>No</title><script>no</script><noscript><p>no</p></noscript>"
    for rest in (f"<body>{body}", body, f"</head><body>{body}", f"<div>{body}</div>"):
        assert said(start + rest) == ["One.", "Two x=1."], rest
    assert said("<head><title>x</title><a href=/>Go</a> on") == ["Go on"]
    # text that a head cannot hold ends it as well
    assert said("<head><title>x</title>\n Go on") == ["Go on"] and said("<head><template><p>no</p></template></head>") == []


def test_viterbi_and_gradient_of_the_field():
    """Decoding against all labelings, expectations against sums over them."""
    import itertools
    import math

    rng = random.Random(3)
    for _ in range(30):
        field = main_text.Field({}, [[rng.uniform(-2, 2) for _ in "ab"] for _ in "ab"])
        scores = [rng.uniform(-3, 3) for _ in range(rng.randint(1, 7))]
        total = lambda y: sum(s for s, on in zip(scores, y, strict=True) if on) + sum(field.steps[a][b] for a, b in itertools.pairwise(y))  # noqa: E731, B023
        every = list(itertools.product((0, 1), repeat=len(scores)))
        assert tuple(field.decode(scores)) == max(every, key=total)
        z = sum(math.exp(total(y)) for y in every)
        on, _ = main_text._expectations(scores, field.steps)
        for i, p in enumerate(on):
            assert abs(p - sum(math.exp(total(y)) for y in every if y[i]) / z) < 1e-9


def test_shingles_of_short_texts():
    from itertools import product

    from pairspace.llm.jaccard_join import shingle_sets

    word = ["a", "b", "c", "a", "d", "e"]
    for lengths in [*product(range(7), repeat=1), *product(range(7), repeat=2), *product(range(7), repeat=3)]:
        said = [word[:n] for n in lengths]
        sets = shingle_sets([" ".join(w).encode() for w in said])
        wanted = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in said]
        assert [len(s) for s in sets] == [len(w) for w in wanted]
        for i in range(len(said)):
            for j in range(i):
                assert len(set(sets[i].tolist()) & set(sets[j].tolist())) == len(wanted[i] & wanted[j])


@pytest.mark.parametrize("given", [[], [(1, 1), (2, 1)], [(1, 0), (3, 0)], [(1, None), (None, 1)]])
def test_labels_of_fewer_than_two_classes(spark, tmp_path, given):
    """Nothing can be learnt: the stage of the pipeline keeps all."""
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "you fool"), (2, None), (3, ""), (4, "a b c")], "doc_id long, text string")
    spark.createDataFrame(given, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == 4


def test_start_tags_as_the_standard_reads_them():
    said = lambda page: [b.text for b in main_text.leaf_blocks(page)]
    # a stray quote is part of a name, not of the text
    assert said('<p class="x"">Hello there</p>') == ["Hello there"]
    assert said("<p title=\"it's 5\" tall\">Hi</p>") == ["Hi"]
    assert said('<p ="q>r">t</p>') == ['r">t']
    # a slash ends neither a script nor a value
    assert said("<script src=https://x.org/>var secret=1;</script><p>a") == ["a"]
    assert said('<script src="a.js"/>var secret=1;</script><p>b') == ["b"]
    assert said("<script>if (a </scripty) {}</script>w") == ["w"]
    (block,) = main_text.leaf_blocks("<div class=content/>text</div>")
    assert "is:content" in block.features
    (block,) = main_text.leaf_blocks("<a href=/>link</a>")
    assert "in:a" in block.features
    # but it closes elements of drawings and formulas
    assert said('<p>x<svg><path d="M0"/><g/></svg> y</p>') == ["x y"]
    assert said("<p>x <math/> y</p>") == ["x y"]
    # values with blanks around the sign, in either quotes, without any; a tag that never ends
    assert [said(f"<p a {v}>e</p>") for v in ("b='c>d'", 'b = "c>d"', "b=", "b = c'd")] == [["e"]] * 4
    assert said('<p>ok</p><p a="never closed>gone</p>') == ["ok"] and said("<p>ok</p><b c") == ["ok"]
    assert said("<p>1 < 2 and <3</p>") == ["1 < 2 and <3"]
    # many quotes, slashes and signs are names
    assert said("<p " + "\"'/= " * 100_000 + ">e</p>") == ["e"]
