"""Every query with SQL against DuckDB on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from quadlake import queries as q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(float(v), 9) if isinstance(v, float) and not math.isnan(v) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, db, name):
    df = q.queries()[name](spark, SF)
    own, other = df.collect(), db.sql(q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    assert rows(df.columns, own) == rows(other.columns, other.fetchall())


def test_all_lines_through_the_codec(spark, db):
    """Every line of every order is encoded and decoded, with its layer, place, id and properties."""
    got = q.all_decoded(spark, SF).selectExpr("zoom", "x", "y", "layer", "CAST(feature_id AS LONG) AS id", "geometry[0][0].x AS gx", "properties['quantity'].d AS quantity", "properties['discount'].d AS discount", "properties['flag'].s AS flag", "properties['status'].s AS status")
    want = db.sql("SELECT l_linenumber AS zoom, l_orderkey AS x, 0 AS y, l_returnflag || l_linestatus AS layer, l_partkey AS id, l_orderkey::FLOAT AS gx, CASE WHEN l_quantity <= 45 THEN l_quantity END AS quantity, l_discount AS discount, l_returnflag AS flag, l_linestatus AS status FROM lineitem")
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_the_codec_gets_every_line(spark, monkeypatch):
    """The registered round trip hands all of lineitem to the encoder."""
    from quadlake.sources import mvt

    seen, encode = [], mvt.encoded
    monkeypatch.setattr(mvt, "encoded", lambda f: seen.append(f.count()) or encode(f))
    q.queries()["mvt_roundtrip"](spark, SF)
    assert seen == [q.read(spark, SF, "lineitem").count()]


def test_text_tables_have_all_rows(spark):
    from quadlake.plans.report import text_table

    assert text_table(spark.range(1000).orderBy("id")) == ["id", *map(str, range(1000))]
