"""Operators that compare documents, against brute force and on the odd cases."""

import hashlib
import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pairspace.llm import fingerprint, jaccard_join, licenses, line_dedup, repeats
from pairspace.llm.components import components
from pairspace.llm.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def rows_of(spark, texts, first=0):
    """Rows with ids from ``first`` and columns whose names the operators use inside."""
    made = spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], "id long, text string")
    return made.withColumns({"n": F.lit("x"), "row": F.lit("x"), "lines": F.lit("x"), "unit": F.lit("x"), "d1": F.lit("x")})


def words(rng, n):
    return [rng.choice("abcdefghijklmnop") + rng.choice("aeiou") + str(rng.randrange(9)) for _ in range(n)]


def test_line_dedup(spark):
    pages = [(f"own {i}\n  menu \nbody {i}\n\nmenu", "a") for i in range(20)] + [("menu\nx", "b"), ("menu", "b")]
    pages += [(None, "a"), ("", "a"), ("menu\n menu", None), ("menu", "a")]
    docs = rows_of(spark, [t for t, _ in pages]).withColumn("site", F.element_at(F.array(*[F.lit(s) for _, s in pages]), (F.col("id") + 1).cast("int")))
    done = {r.id: r for r in line_dedup.dedup_lines(docs, "site", "text", 0.5, 3).collect()}
    assert done[3].text == "own 3\nbody 3\n" and done[3].n_lines_removed == 2 and done[3].lines == "x"
    assert [done[i].text for i in (20, 21, 22, 23, 24, 25)] == ["menu\nx", "menu", None, "", "menu\n menu", ""]
    # not more than the ratio: the line stays
    assert {r.n_lines_removed for r in line_dedup.dedup_lines(docs, "site", "text", 0.92, 3).collect()} == {0}
    assert line_dedup.dedup_lines(docs.filter("false"), "site", "text").count() == 0


def test_licences(spark):
    mit = "MIT License\n\nCopyright (c) 2020 Someone\n\n" + licenses.MIT.replace('"', "“").replace(" ", "  ").upper()
    said = [mit, "Some text.\nReleased under the M.I.T.  licence", "x\nthis work is Licenced under the gnu general public licence, VERSION 3!"]
    said += ["Licensed under the MIT License and more", None, "", "words " * 50_000 + "\nLicensed under CC BY-NC 4.0."]
    found = licenses.scan_licenses(rows_of(spark, said), "text").select("id", "unit", "license").collect()
    assert sorted(map(tuple, found)) == [(0, 0, "MIT"), (0, 3, "MIT"), (2, 2, "GPL-3.0"), (6, 2, "CC-BY-NC-4.0")]
    assert licenses.scan_licenses(rows_of(spark, said).filter("false"), "text").count() == 0
    import re

    assert all(re.search(licenses.ANCHORS, t, re.I) for _, t in licenses.known_notices())
    assert licenses.known_digests(spark).count() > 500


def test_licences_with_parted_words(spark):
    said = ["Released\nunder GPLv3", "x\n\nThis work is available\tunder\u00a0CC BY 4.0\n\nx", "released -- under MIT", "distributed\n(c) 2020 X\nunder the MIT License"]
    found = licenses.scan_licenses(rows_of(spark, said), "text").select("id", "unit", "license").collect()
    assert sorted(map(tuple, found)) == [(0, 0, "GPL-3.0"), (1, 2, "CC-BY-4.0"), (2, 0, "MIT"), (3, 0, "MIT")]


def test_licences_over_several_paragraphs(spark):
    parts = licenses.MIT.replace(" The above copyright", "\n\nThe above copyright").replace(" THE SOFTWARE IS PROVIDED", "\n \nTHE SOFTWARE IS PROVIDED")
    said = [f"A project.\n\nMIT License\n\nCopyright (c) 2020 X\n\n{parts}\n\nThe end.", f"Read on.\r\n\r\n{parts}".replace("\n\n", "\r\n\r\n"), f"{parts} no\n\nx"]
    found = licenses.scan_licenses(rows_of(spark, said), "text").select("id", "license", "digest").collect()
    assert sorted((r.id, r.license) for r in found) == [(0, "MIT"), (0, "MIT"), (1, "MIT")] and len({r.digest for r in found}) == 2


@pytest.mark.skipif(not os.path.isfile("/usr/share/common-licenses/GPL-3"), reason="no licence texts")
def test_full_licence_texts(spark):
    read = lambda name: open(f"/usr/share/common-licenses/{name}", encoding="utf-8").read()
    names = ["GPL-2", "GPL-3", "LGPL-3", "MPL-2.0", "CC0-1.0", "Apache-2.0"]
    said = [read(n) for n in names] + ["Notes\n\n" + read("GPL-3") + "\n\nmore notes"]
    found = licenses.scan_licenses(rows_of(spark, said), "text").select("id", "unit", "license").collect()
    whole = sorted((r.id, r.license) for r in found if r.unit == 0)
    assert whole == [(0, "GPL-2.0"), (1, "GPL-3.0"), (2, "LGPL-3.0"), (3, "MPL-2.0"), (4, "CC0-1.0"), (5, "Apache-2.0")]
    assert (6, "GPL-3.0") in {(r.id, r.license) for r in found}


def test_fingerprints_add_up(spark):
    whole = rows_of(spark, ["one two three\nfour five six seven\n\nlast"])
    parts = rows_of(spark, ["four five six seven", "last\none two three"])
    other = rows_of(spark, ["one two three\nlast"])
    print_of = lambda df: df.groupBy().agg(F.first("fingerprint").alias("f"))
    total = print_of(fingerprint.fingerprint(whole.withColumn("k", F.lit(1)), ["k"], "text"))
    halves = print_of(fingerprint.fingerprint(parts.withColumn("k", F.lit(1)), ["k"], "text"))
    assert total.first().f == halves.first().f
    less = print_of(fingerprint.fingerprint(other.withColumn("k", F.lit(1)), ["k"], "text")).first().f
    both = total.withColumnRenamed("f", "a").join(print_of(fingerprint.fingerprint(parts.filter("id = 0").withColumn("k", F.lit(1)), ["k"], "text")))
    assert both.select(fingerprint.add(F.col("a"), F.col("f"), -1).alias("r")).first().r == less
    assert both.select(fingerprint.likeness(F.col("a"), F.col("a")).alias("r")).first().r == 1.0


def test_edit_fingerprints(spark):
    rng = random.Random(4)
    said = [" ".join(words(rng, rng.randrange(60))) + "\n" + " ".join(words(rng, 5)) for _ in range(20)] + [None, "", "é😀x", "lang " * 20_000]
    docs = rows_of(spark, said).unionByName(rows_of(spark, said[:2]))
    got = {r.id: r for r in fingerprint.edit_fingerprints(docs, "id", "text").collect()}
    plain = [t or "" for t in said]
    assert len(got) == len(plain)
    for i, t in enumerate(plain):
        half = len(t) // 2
        edited = t[: len(t) - half] + plain[(i + 1) % len(plain)][:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[20].fingerprint == got[21].fingerprint and got[20].near_next == 1.0
    assert len({got[i].fingerprint for i in range(20)}) == 20
    alone = fingerprint.edit_fingerprints(docs.filter("id = 5"), "id", "text").first()
    assert alone.near_next == 1.0
    assert fingerprint.edit_fingerprints(docs.filter("false"), "id", "text").count() == 0


def test_components(spark):
    rng = random.Random(6)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(140)] + [(i, i + 1) for i in range(400, 440)] + [(7, 7), (999, 999)]
    root = {n: n for link in links for n in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*links, (None, 3)], "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == {n: find(n) for n in root}
    assert components(df.filter("false")).count() == 0


def brute_components(texts, part=75):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} - {()})
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        common = len(sets[i] & sets[j])
        if common and 100 * common >= part * (len(sets[i]) + len(sets[j]) - common):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("rare", [64, 2])
def test_jaccard_join(spark, monkeypatch, rare):
    """Groups of near copies around several bases, a common passage, short texts and copies."""
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    rng = random.Random(8)
    common = words(rng, 30)
    said = []
    for size in (6, 9, 14, 30, 70, 160):
        base = words(rng, size)
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 12))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = [rng.choice(base)]
            said.append(" ".join(copy if rng.random() < 0.8 else copy + common[: rng.randrange(1, 9)]))
    said += [" ".join(common + words(rng, n)) for n in (0, 2, 4, 8, 12, 200)]
    said += ["", None, " \t", "one", "ONE", "one two", "a b c d e", "A\x0bb  c d\ne", said[3], "w " * 3_000, "\x85 x\x1cy"]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(rows_of(spark, said), "id", "text").collect()}
    assert got == brute_components(said)
    assert len({c for _, c in got.values()}) > 10


def test_jaccard_join_odd_tables(spark):
    same = "one two three four five six"
    docs = rows_of(spark, [same, same, None]).unionByName(rows_of(spark, [same])).withColumn("id", F.when(F.col("id") != 1, F.col("id")))
    got = sorted((str(r.id), r.n_shingles, str(r.component_id)) for r in jaccard_join.near_duplicates(docs, "id", "text").collect())
    assert got == [("0", 2, "0"), ("0", 2, "0"), ("2", 0, "2"), ("None", 2, "0")]
    assert jaccard_join.near_duplicates(docs.filter("false"), "id", "text").count() == 0


def brute_repeats(texts, length, keep_first):
    data = [(t or "").encode() for t in texts]
    places = {}
    for i, d in enumerate(data):
        for k in range(len(d) - length + 1):
            places.setdefault(d[k : k + length], []).append((i, k))
    out = []
    for i, d in enumerate(data):
        gone = [False] * len(d)
        for k in range(len(d) - length + 1):
            at = places[d[k : k + length]]
            if len(at) > 1 and not (keep_first and at[0] == (i, k)):
                gone[k : k + length] = [True] * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("keep_first", "together"), [(False, 3_000), (True, 3_000), (False, 1), (True, 1)])
def test_repeats(spark, monkeypatch, keep_first, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)
    monkeypatch.setattr(repeats, "SEGMENT", 150)
    rng = random.Random(9)
    passage = " ".join(words(rng, 30))
    said = []
    for _ in range(25):
        cut = sorted(rng.sample(range(len(passage)), 2))
        said.append(" ".join(words(rng, rng.randrange(30))) + passage[cut[0] : cut[1]] + "é" + " ".join(words(rng, rng.randrange(20))))
    said += ["a" * 130, "ab" * 70, said[0], said[1] + said[1], "", None, "short", "\x00" * 90, "x" + "\x00" * 60]
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.find_repeats(rows_of(spark, said), "id", "text", 40, keep_first, 16).collect()}
    assert [got[i] for i in range(len(said))] == brute_repeats(said, 40, keep_first)


def test_longest_previous_factors():
    rng = random.Random(10)
    for _ in range(200):
        s = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 25)))
        keys = [s[i:] for i in range(len(s))]
        brute = [max((repeats._common(s[j:], s[i:]) for j in range(i)), default=0) for i in range(len(s))]
        later = [max((repeats._common(s[j:], s[i:]) for j in range(i + 1, len(s))), default=0) for i in range(len(s))]
        assert repeats.previous_and_next_factors(keys) == (brute, later)


def test_repeats_empty(spark):
    assert repeats.find_repeats(rows_of(spark, ["x"]).filter("false"), "id", "text").count() == 0


@needs_data
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    done = con.execute(SQL[name])
    found = [c[0] for c in done.description]
    df = QUERIES[name](spark, SF_DIR)
    assert sorted(df.columns) == sorted(found)
    assert sorted(map(tuple, df.select(*found).collect()), key=repr) == sorted(done.fetchall(), key=repr)


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(None, "no id", "en", None, 5), (10_001, None, None, "src0", None), (10_001, None, None, "src0", None)], docs.schema))
    now = docs.unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, corpus_pipeline.materialise(stage(spark, now, SF_DIR), "test")
        assert now.columns == docs.columns + (["piece_ids"] if name == corpus_pipeline.STAGES[-1][0] else [])
        assert 0 < now.count() <= before.count()
    ids = [r.doc_id for r in now.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {None, 10_001} <= set(ids)
    assert now.filter("size(piece_ids) = 0 and text <> ''").count() == 0
