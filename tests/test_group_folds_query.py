"""The query of group folds returns a fold for every order, the whole customer in one."""

from collections import Counter

import duckdb

from tabloom import plans


def test_a_fold_for_every_order(spark, sf_dir):
    orders = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{sf_dir}/orders.parquet").collect()}
    got = {r.o_orderkey: r.fold for r in plans.QUERIES["folds_group"](spark, sf_dir).collect()}
    assert got.keys() == orders.keys()
    of = {}
    assert all(of.setdefault(orders[k], f) == f for k, f in got.items())
    # The greedy loop's rows of each fold.
    rows = [0] * 5
    for n in sorted(Counter(orders.values()).values(), reverse=True):
        rows[rows.index(min(rows))] += n
    assert [Counter(got.values())[f] for f in range(5)] == rows


def test_sql_gives_a_null_customer_a_fold():
    con = duckdb.connect()
    con.sql("CREATE TABLE orders AS SELECT i AS o_orderkey, CASE WHEN i % 4 > 0 THEN i % 7 END AS o_custkey FROM range(60) r(i)")
    assert sorted(k for k, _ in con.sql(plans.ORACLES["folds_group"]).fetchall()) == list(range(60))
