"""Every query that has SQL against that SQL, in DuckDB on the smallest tables; op6 to op8 as far as SQL reaches."""

import os

import duckdb
import pytest

from loomgraph.llm import oracles, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "benchmark", "pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    return con


def rows(frame, columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in frame)))


def compare(spark, duck, name, sql):
    got = duck.execute(sql)
    columns = sorted(c[0] for c in got.description)
    want = [dict(zip((c[0] for c in got.description), r, strict=True)) for r in got.fetchall()]
    out = queries.QUERIES[name](spark, DATA)
    assert rows(out.select(*columns).collect(), columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(oracles.SQL))
def test_query_against_sql(spark, duck, name):
    compare(spark, duck, name, oracles.SQL[name])


def test_rules_base_against_sql(spark, duck):
    compare(spark, duck, "op6_rules", oracles.OP6_BASE)


def test_packing_totals_against_sql(spark, duck):
    """Each document's ids lie in one piece each, sequences are gapless, and padding is small."""
    out = queries.op8_packing(spark, DATA).toPandas()
    duck.register("pieces", out)
    found = duck.execute("""
      SELECT (SELECT count(*) FROM documents) = (SELECT count(DISTINCT doc_id) FROM pieces),
        (SELECT bool_and(total = doc_tokens) FROM (SELECT doc_id, sum(length) AS total, max(doc_tokens) AS doc_tokens FROM pieces GROUP BY doc_id)),
        (SELECT bool_and("offset" = before) FROM (SELECT "offset", coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pieces)),
        (SELECT bool_and(n <= 1024) FROM (SELECT sum(length) AS n FROM pieces GROUP BY sequence_id))
    """).fetchone()
    assert found == (True, True, True, True)
