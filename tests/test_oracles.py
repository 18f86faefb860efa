"""Every registered query of the package itself against its SQL in DuckDB."""

import duckdb
import pytest

from tabloom import plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-13, abs=0)
    return a == b


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = plans.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    if name not in plans.ORACLES:
        assert got
        return
    rel = duck.sql(plans.ORACLES[name])
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    want = sorted((tuple(r[i] for i in order) for r in rel.fetchall()), key=str)
    assert len(got) == len(want)
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    assert not wrong, wrong[:3]
