"""A few registered queries against their SQL; the others are checked by running __spark_entry__ on larger data."""

import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from pairspace.workload.registry import QUERIES, oracles

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
NAMES = ["token_spans", "shortest_path_tree", "entity_head_tree", "chinese_whispers", "similar_pairs", "relation_scores", "ceaf_entity_regions", "coref_mentions", "graph_export", "rule_annotate", "subtree_patterns", "freq_pair", "association_star", "cosine_pairs", "b_cubed", "thesaurus_topn", "gold_profile"]

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def plain(value):
    return round(value, 5) if isinstance(value, float) else value


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in TABLES.split():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    df = queries()[name](spark, SF_DIR)
    cols = sorted(df.columns)
    got = [tuple(plain(v) for v in r) for r in df.select(*cols).collect()]
    done = con.execute(oracle_sql()[name])
    found = [c[0] for c in done.description]
    assert sorted(found) == cols
    expected = [tuple(plain(r[found.index(c)]) for c in cols) for r in done.fetchall()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_registry():
    assert set(oracle_sql()) <= set(queries())
    assert set(QUERIES) - set(oracles()) == {"ceaf_mention", "ceaf_entity", "twinless_ceaf"}


@needs_data
def test_entry(spark):
    assert entry(spark).columns == ["jo", "bim", "cnt", "lmi"]
