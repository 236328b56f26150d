"""Every core query runs, has an oracle where SQL can express it, and agrees with it on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from compare import canonical

from lexloom.plans import catalog

DATA = "/root/testdata/sf0.001"
NO_SQL = {"yake_keywords", "mmr_diversity", "consensus_tags_yake", "kmeans_category", "chunks_made", "model_metrics_yake", "markdown_pieces"}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def test_oracles():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == NO_SQL


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    got = catalog.queries()[name](spark, DATA).toPandas()
    if name in catalog.oracle_sql():
        want = con.sql(catalog.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canonical(got) == canonical(want)
    else:
        assert len(got)


def test_nothing_needs_the_optional_subpackage():
    for root, _, files in os.walk(os.path.dirname(os.path.abspath(catalog.__file__)) + "/.."):
        if os.path.basename(root) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "lexloom.llm" not in open(os.path.join(root, f)).read(), f
