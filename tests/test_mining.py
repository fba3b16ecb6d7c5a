from pairspace.plans.mining import mine, parse_documents


def test_documents_to_vectors(spark):
    text = "the dog chased the cat. the dog saw a cat. a cow and a dog ran. the dog chased a cat"
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    parses = parse_documents(docs)
    assert parses.count() == 4
    mined = mine(parses, min_patterns=0, min_pairs=0, max_contexts=2)
    assert mined.features.filter("pattern = 'X chas the Y' or pattern = 'X chased the Y'").count() == 1
    assert mined.contexts.groupBy("jo").count().filter("count > 2").count() == 0
    assert mined.vectors.count() == mined.contexts.count()
    assert mined.frequencies["pair"].count() == mined.pairs.count()
    thesaurus = spark.createDataFrame([("dog#NN", "cat#NN", 1.0)], "target string, expansion string, similarity double")
    assert {(r.noun1, r.noun2) for r in mine(parses, thesaurus).features.collect()} == {("dog", "cat")}
