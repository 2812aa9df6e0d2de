"""Every query with SQL against DuckDB; alignment against the defects that were injected."""

import math

import duckdb
import pytest

from tempora.operators import intervals
from tempora.plans.all_queries import ORACLE, QUERIES
from tempora.shipping import ship

SF = "/root/testdata/sf0.001"
TABLES = ("orders", "events", "documents")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    sql = duck.sql(ORACLE[name])
    assert sorted(sql.columns) == columns
    assert got == sorted((tuple(plain(r[sql.columns.index(c)]) for c in columns) for r in sql.fetchall()), key=repr)


def test_injected_defects_are_found(spark):
    rows = QUERIES["auto_sync"](ship(spark), SF).collect()
    assert {r["film_id"] % 5 for r in rows} >= {0, 1, 2, 3}
    for r in rows:
        kind, offsets = r["film_id"] % 5, list(r["offsets"])
        if kind in (0, 1):
            assert (r["mode"], r["verdict"]) == ("shifted", "solid") and abs(r["offset_ms"] - (0, -33_000)[kind]) <= 400
        elif kind == 2:
            assert r["mode"] == "drifting" and abs(r["ratio"] - 0.96) < 1e-3 and abs(r["offset_ms"]) <= 400
        elif kind == 3:
            assert r["mode"] == "recut" and len(offsets) == 2 and abs(offsets[0] + 21_000) <= 400 and abs(offsets[1] - 33_000) <= 400
        else:
            assert r["verdict"] != "solid"


def test_range_joins_are_equi_joins(spark):
    for name in ("overlap_score", "offset_sweep", "spoken_semi", "hinted", "nearest_cut"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_groups_do_not_hang_on_the_order_of_equal_values(spark):
    """The SQL leaves it open which of two equal values begins a run; sf0.1 has this film."""
    rows = [(730, k, v) for k, v in enumerate((1868, 2414, 2639, 2658, 2178, 316, 316, 1868))]
    con = duckdb.connect()
    con.sql("create table measured as select * from (values " + ", ".join(map(str, rows)) + ") t(film_id, slice_no, offset_ms)")
    sql = "with " + ORACLE["cluster_groups"][ORACLE["cluster_groups"].index("r as (select *, case when offset_ms") :]
    first = "window w as (partition by film_id order by offset_ms)"
    assert sql.count(first) == 1
    assert [con.sql(sql.replace(first, f"{first[:-1]}, {tie})")).fetchall() for tie in ("slice_no", "slice_no % 6")] == [[(730, 2)], [(730, 1)]]
    for order in (rows, rows[::-1]):
        for parts in (1, 8):
            df = spark.createDataFrame(order, "film_id long, slice_no int, offset_ms int").repartition(parts)
            assert intervals.clusters(df, "film_id", "offset_ms").collect() == [(730, 2)]
