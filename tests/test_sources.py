import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pairspace.functions.text import format_bag, parse_bag
from pairspace.operators.pairs import noun_pairs
from pairspace.operators.profile import gold_nouns, gold_profile, histogram
from pairspace.plans.numbering import running_sums
from pairspace.plans.storage import shared_root
from pairspace.sources import corpus, matrix_market, ordered, questions, tables
from pairspace.sources.coref import coref_mentions
from pairspace.sources.json_lines import json_bag, json_map, parse_json_lines

SENTENCE = (
    "The\tthe\tDT\t1\t2\tNMOD\ndog\tdog\tNN\t2\t3\tSBJ\nchased\tchase\tVBD\t3\t0\tROOT\na\ta\tDT\t4\t6\tNMOD\n"
    "small\tsmall\tJJ\t5\t6\tNMOD\ncat\tcat\tNN\t6\t3\tOBJ\n.\t.\tSENT\t7\t3\tP\n"
)


def test_vertical_corpus(spark, tmp_path):
    text = f'<text id="ukwac:u">\n<s>\n{SENTENCE}</s>\n<s>\nbad\tline\n</s>\n</text>\n<text id="ukwac:v">\n<s>\nOk\tok\tUH\t1\t0\tROOT\n</s>\n</text>\n'
    (tmp_path / "c.txt").write_text(text)
    parses = corpus.conll_parses(corpus.read_vertical(spark, str(tmp_path / "c.txt"))).withColumn("sid", F.length("text"))
    assert rows(parses, "text") == sorted([("The dog chased a small cat .",), ("Ok",), (None,)], key=repr)
    dog = parses.filter("text like 'The%'")
    assert [t.begin for t in dog.first().tokens] == [0, 4, 8, 15, 17, 23, 27]
    assert corpus.dependency_edges(dog).count() == 6
    assert rows(noun_pairs(dog), "noun1", "noun2") == [("dog", "cat")]


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"\\n', 0.5), (2, "b", None)], "id long, name string, x double")
    for codec in (None, "gzip", "bzip2"):
        tables.write_tsv(df, str(tmp_path / "t"), codec)
        assert rows(tables.read_tsv(spark, str(tmp_path / "t"), "id long, name string, x double")) == rows(df)
    assert rows(tables.read_tsv(spark, str(tmp_path / "t"), "id long, name long"))[0] == (1, None)
    lines = spark.createDataFrame([("a\tb",), ("c",)], "value string")
    assert rows(tables.first_field(lines)) == [("a",), ("c",)]


def test_bags_and_vectors(spark):
    df = spark.createDataFrame([("8\tduck::@::tiger\t{(627,53.0),(501,72.3)}",), ("9\tx\t{}",)], "value string")
    got = tables.parse_vector_text(df)
    assert [(r.vid, r.pair, [tuple(e) for e in r.values]) for r in got.orderBy("vid").collect()] == [
        (8, "(duck,tiger)", [(627, 53.0), (501, 72.3)]), (9, "x", [])
    ]
    assert got.select(format_bag(F.col("values"))).first()[0] == "{(627,53.0),(501,72.3)}"
    bad = spark.createDataFrame([("{(x,1.0)}",)], "t string").select(parse_bag(F.col("t")).alias("b")).first().b
    assert tuple(bad[0]) == (None, 1.0)
    lists = spark.createDataFrame([(1, 2, "p1, p2")], "cluster int, n int, items string")
    assert rows(tables.cluster_list_explode(lists)) == [(1, "p1"), (1, "p2")]


def test_json(spark):
    lines = spark.createDataFrame([('{"a": "x", "b": 1, "c": null, "d": {"e": "f"}, "g": [1, [2, 3]]}',), ("  ",)], "value string")
    got = parse_json_lines(lines)
    assert got.count() == 1
    r = got.select("json", json_map(F.col("json")["d"]).alias("d"), json_bag(F.col("json")["g"]).alias("g")).first()
    assert (r.json["a"], r.json["b"], r.json["c"]) == ("x", "1", None)
    assert r.d == {"e": "f"} and r.g == ["1", "2", "3"]
    deep = spark.createDataFrame([("[1,[2,[3,[4,[]]]]]",), ('["[x","{y",[["z"]]]',), ("[]",), (None,)], "v string")
    assert [r.g for r in deep.select(json_bag(F.col("v")).alias("g")).collect()] == [["1", "2", "3", "4"], ["[x", "{y", "z"], [], None]
    broken = spark.createDataFrame([('{"a": ',)], "value string")
    assert parse_json_lines(broken, malformed="null").first().json is None
    with pytest.raises(Exception, match="malformed JSON line"):
        parse_json_lines(broken).collect()


def test_vertical_corpus_with_other_line_ends(spark, tmp_path):
    lines = ["<text id=\"ukwac:x\">", "<s>", "a\tb", "</s>", "<s>", "c\td", "e\tf", "</s>", "</text>", ""]
    found = []
    for name, end in (("unix", b"\n"), ("dos", b"\r\n")):
        (tmp_path / name).write_bytes(end.join(x.encode() for x in lines))
        found.append(rows(corpus.read_vertical(spark, str(tmp_path / name))))
    assert found[0] == found[1] and len(found[0]) == 2


def test_matrix_market(spark, tmp_path):
    entries = spark.createDataFrame([(2, 1, 0.5), (1, 1, 0.0), (2, 2, 0.0)], "row long, col long, distance double")
    stats = spark.createDataFrame([(2, 9, 3)], "n_pairs long, n_features long, n_entries long")
    matrix_market.write_matrix_market(entries, stats, str(tmp_path / "m"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "m").glob("part-*")))
    assert written.splitlines() == [*matrix_market.HEADER, "2 2 3", "1 1 0.0", "2 1 0.5", "2 2 0.0"]
    with pytest.raises(ValueError):
        matrix_market.check_entries(entries.withColumn("distance", F.lit("x")))


def test_questions(spark, tmp_path):
    def block(tag, letter):
        lines = ["190 FROM REAL SATs", f"ostrich bird {tag}"] + [f"a{i} b{i} n:n" for i in range(5)] + [letter]
        return "\r\n".join(lines)

    text = "# comment\r\nML: x\r\n\r\n" + "\r\n\r\n".join([block("v:n", "a"), block("n:n", "c"), block("n:n", "e")]) + "\r\n"
    (tmp_path / "q.txt").write_bytes(text.encode())
    got = questions.mcq_clean(questions.read_question_blocks(spark, str(tmp_path / "q.txt"))).orderBy("qid", "variant").collect()
    assert [(r.qid, r.variant, r.question, r.solution) for r in got] == [
        (1, 0, "(ostrich,bird)", 2), (1, 1, "(bird,ostrich)", 2), (2, 0, "(ostrich,bird)", 4), (2, 1, "(bird,ostrich)", 4)
    ]
    assert got[0].answers == [f"(a{i},b{i})" for i in range(5)] and got[1].answers[0] == "(b0,a0)"


def test_coreference(spark):
    lines = ["#begin", "w (1", "w (2)|(3", "w 3)", "", "w 1)|(4(5)4)", "w -"]
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate(lines)], "doc string, line_no long, value string")
    assert rows(coref_mentions(df), "cluster", "start", "end") == [("1", 1, 4), ("2", 2, 2), ("3", 2, 3), ("4", 4, 4)]


def test_gold_and_histogram(spark):
    raw = spark.createDataFrame([("dog-n", "x", "coord", "cat-n"), ("run-v", "x", "coord", "cat-n")], "c0 string, c1 string, c2 string, c3 string")
    gold = gold_nouns(raw)
    assert rows(gold) == [("dog", "cat", "coord")]
    assert {(r.level, r.n) for r in gold_profile(gold).collect()} == {
        (k, 1) for k in ("all", "label", "noun1", "noun2", "noun1_label", "noun2_label")
    }
    values = spark.createDataFrame([(-2.0,), (-1.0,), (1.49,), (1.5,), (None,)], "v double")
    assert rows(histogram(values, "v")) == [(0, 1), (1, 1), (100, 1), (101, 1)]


def test_shared_folder_is_read_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert named is None or shared_root(spark) == named


def test_running_sums_over_slices(spark):
    """Groups of one row, of many slices, and null keys."""
    rng = random.Random(5)
    given = [(rng.choice(["a", "b", None, "long", "long", "long"]), i, rng.randrange(-3, 4)) for i in range(900)]
    shuffled = rng.sample(given, len(given))
    df = spark.createDataFrame(shuffled, "k string, i int, v int").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r["sum"] for r in running_sums(df, ["k"], ["i"], F.col("v")).collect()}
        lines = [("big", i, "w (1" if i % 4 == 1 else "w 1)" if i % 4 == 3 else "# no" if i % 4 == 0 else "w -") for i in range(1200)]
        lines += [("small", i, f"w (2)|(2)|({i}") for i in range(3)] + [("other", 0, "w 5)"), ("other", 1, "w (5"), ("other", 2, "w 5)")]
        found = coref_mentions(spark.createDataFrame(lines, "doc string, line_no long, value string").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    so_far, want = {}, {}
    for k, i, v in given:
        want[i] = so_far[k] = so_far.get(k, 0) + v
    assert got == want
    assert sorted((r.cluster, r.start, r.end) for r in found if r.doc == "big") == sorted(("1", 3 * k + 1, 3 * k + 3) for k in range(300))
    assert [(r.cluster, r.start, r.end) for r in found if r.doc == "other"] == [("5", 2, 3)]
    assert sorted((r.cluster, r.start, r.end) for r in found if r.doc == "small") == [("2", 1, 1), ("2", 2, 2), ("2", 3, 3)]


def test_order_of_files_and_splits(spark, tmp_path):
    """The same numbers from one file, from five, and from any size of splits."""
    lines = [f"line {i}" * (1 + i % 7) for i in range(2000)]
    (tmp_path / "one.txt").write_text("\n".join(lines) + "\n")
    (tmp_path / "five").mkdir()
    for k in range(5):
        (tmp_path / "five" / f"part-{k}").write_text("\n".join(lines[k * 400 : k * 400 + 400]) + "\n")
    default = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (default, "3000", "20000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for path in ("one.txt", "five"):
                got = ordered.numbered_records(spark, str(tmp_path / path)).collect()
                assert sorted((r.line_no, r.value) for r in got) == [*enumerate(lines, 1)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", default)


def test_sorted_export(spark, tmp_path):
    rng = random.Random(8)
    edges = [(rng.randrange(30), rng.randrange(1000), i) for i in range(1500)]
    graph = spark.createDataFrame(edges, "nid1 int, nid2 int, similarity int").dropDuplicates(["nid1", "nid2"]).repartition(7)
    ids = spark.createDataFrame([(i, f"p{i}") for i in range(30)], "id long, pair string")
    where, names = ordered.write_graph(graph, ids, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out" / "graph").glob("part-*"))
    read = [tuple(map(int, x.split("\t"))) for p in parts for x in p.read_text().splitlines()]
    assert read == sorted(tuple(r) for r in graph.collect())
    assert sorted(tuple(r) for r in tables.read_dictionary(spark, names).collect()) == [(i, f"p{i}") for i in range(30)]
    assert ordered.numbered_records(spark, where).orderBy("line_no").first().value == "\t".join(map(str, read[0]))


def test_conll_places_of_long_sentences(spark):
    """Places run on over blocks of tokens, by sums of lengths: the text is joined once, not again before each token."""
    words = [("w" * (1 + i % 7), i) for i in range(150)]
    parse = corpus.TOKEN_MARK.join("\t".join([w, w, "NN", str(i + 1), "0", "dep"]) for w, i in words)
    df = spark.createDataFrame([(1, parse), (2, parse.replace("NN\t3\t", "NN\t"))], "sid int, parse string")
    got = {r.sid: r for r in corpus.conll_parses(df).collect()}
    assert got[2].text is None and got[2].tokens is None
    assert [got[1].text[t.begin : t.end] for t in got[1].tokens] == [w for w, _ in words]
    assert corpus.conll_parses(df)._jdf.queryExecution().analyzed().toString().count("array_join") == 1
