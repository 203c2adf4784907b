"""The queries over the smallest tables: against their SQL where there is one, and the pipeline end to end."""

import duckdb
import pytest

from ledgerloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    q = con.execute(SQL[name])
    cols = [c[0] for c in q.description]
    fix = lambda rows: sorted(repr([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    assert fix(q.fetchall()) == fix(tuple(r) for r in QUERIES[name](spark, SF).select(cols).collect())


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.filter("not exact").count() == 0
