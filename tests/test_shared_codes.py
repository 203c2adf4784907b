"""Queries held against their SQL over small tables in which parts share a code (keys of six digits are cut to five)."""

import duckdb
import pytest

from ledgerloom.plans import registry

TABLES = ("lineitem", "part", "orders")


@pytest.fixture(scope="module")
def shared(tmp_path_factory):
    d = str(tmp_path_factory.mktemp("shared"))
    con = duckdb.connect()
    con.execute("create table part as select k::BIGINT AS p_partkey, 'part ' || chr((65 + k % 11)::INT) || ' ' || chr((97 + (k * 7) % 13)::INT) AS p_name, 'Brand#' || (k % 5)::VARCHAR AS p_brand, (k % 50 + 1)::INT AS p_size, (900 + k % 1000)::DOUBLE AS p_retailprice FROM (SELECT unnest([10001, 10002, 100010, 100011, 100019, 100020, 100025, 10003, 100031]) AS k)")
    con.execute("create table lineitem as select (o * 41 + 1)::BIGINT AS l_orderkey, n::INT AS l_linenumber, k AS l_partkey, (k % 10 + 1)::BIGINT AS l_suppkey, (1 + (o + k) % 3)::DOUBLE AS l_quantity, (1 + (o + k) % 3) * (900 + k % 1000) * 1.0::DOUBLE AS l_extendedprice FROM range(120) t(o), (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) AS n FROM part) WHERE (o + k) % 4 < 3")
    con.execute("create table orders as select i::BIGINT AS o_orderkey, (i % 50)::BIGINT AS o_custkey FROM range(900) t(i)")
    for t in TABLES:
        con.execute(f"copy {t} to '{d}/{t}.parquet' (format parquet)")
    return d, con


def same(spark, shared, name):
    d, con = shared
    q = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in q.description]
    want = sorted(q.fetchall(), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in registry.queries()[name](spark, d).collect()), key=repr)
    assert got == want and want


def test_expected_items_of_one_code(spark, shared):
    same(spark, shared, "expected_items")


def test_prices_that_differ_are_no_values(spark, shared):
    same(spark, shared, "price_differences")


def test_extracted_items_of_one_code(spark, shared):
    same(spark, shared, "extracted_documents")


@pytest.mark.parametrize("name", ["rescued_pages", "component_hierarchy", "interval_join"])
def test_linear_queries(spark, shared, name):
    same(spark, shared, name)


def test_first_differences(spark, shared):
    same(spark, shared, "discrepancy_dedup")


def test_coverage_counts_codes_of_both_sides(spark, shared):
    same(spark, shared, "extraction_coverage")
    found, detected = (spark.createDataFrame([(c,) for c in x], "code string") for x in (["a", "B", "x", "y", None], ["A", "b", "C", "", "b"]))
    from ledgerloom.operators.aggregates import coverage

    r = coverage(found, detected).first()
    assert (r.detected, r.extracted, r.covered, r.ratio, r.warn) == (3, 4, 2, 1.333, False)


def test_every_item_is_a_component(spark, shared):
    same(spark, shared, "component_blocks")
    d, con = shared
    assert registry.queries()["component_blocks"](spark, d).count() == con.execute("select count(*) from (select distinct l_orderkey, substr(lpad(l_partkey::VARCHAR, 5, '0'), 1, 5) from lineitem)").fetchone()[0]
