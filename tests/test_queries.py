"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from sightline import plans
from sightline.plans import imaging

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, db, name):
    got, want = plans.QUERIES[name](spark, sf_dir), db.sql(plans.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted([plain(v) for v in r] for r in got.collect()) == sorted([plain(r[k]) for k in at] for r in want.fetchall())


def test_queries_without_sql_have_a_slow_version():
    from pathlib import Path

    slow = (Path(__file__).parent / "test_slow.py").read_text()
    for name in set(plans.QUERIES) - set(plans.ORACLE_SQL):
        assert f'"{name}"' in slow or name.removeprefix("kernel_") in imaging.FILTERS, name


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_ratio_match_over_many_descriptors_equals_its_sql(spark, tmp_path):
    """More descriptors than one block has; the first keys aren't the nearest."""
    c = duckdb.connect()
    c.sql(f"copy (select (range * 7 + 1)::bigint as s_suppkey from range(5000)) to '{tmp_path}/supplier.parquet'")
    c.sql(f"copy (select (range + 1)::bigint as p_partkey from range(300)) to '{tmp_path}/part.parquet'")
    for t in ("supplier", "part"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    got = plans.QUERIES["lowe_ratio_match"](spark, str(tmp_path)).collect()
    assert got and sorted(map(tuple, got)) == sorted(c.sql(plans.ORACLE_SQL["lowe_ratio_match"]).fetchall())


def test_world_map_has_all_sectors(spark, tmp_path):
    from sightline.plans import machines

    spark.range(1200).selectExpr("id AS n_nationkey", "string(id) AS n_name", "id % 5 AS n_regionkey").write.parquet(f"{tmp_path}/nation.parquet")
    assert len(machines.sector_list(spark, str(tmp_path))) == 1200


def test_artifact_marks_learn_from_moving_frames_only(spark, tmp_path):
    """Camera 0 is still at first, with a bright thing in view; camera 1 stays so."""
    import numpy as np

    rng, still = np.random.default_rng(5), np.full(64, 128.0)
    still[27] = 250
    rows = [(2 * k + c, ((still if c or k < 40 else rng.normal(128, 20, 64)) / 212 - 0.6).tolist()) for k in range(80) for c in (0, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["camera_id"]: (r["accepted"], r["marked"]) for r in plans.QUERIES["artifact_marks"](spark, str(tmp_path)).collect()}
    assert got == {0: (True, 0), 1: (False, 0)}
