"""Every query with SQL gives the same rows as DuckDB; the others run."""

import math
import os
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import kernels as K
from voxelframe.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF, t)}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.6g}"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted(tuple(map(str, (plain(r[k]) for k in order))) for r in values)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    cur = duck.execute(SQL[name])
    want = rows([c[0] for c in cur.description], cur.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    off = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not off, off[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["gabor_features", "gist_features", "texture_features", "curvature_features"])
def test_every_supplier_has_features(spark, name):
    sf = "/root/testdata/sf0.01"
    keys = [r[0] for r in spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey").collect()]
    assert len(keys) > 40
    assert sorted(r[0] for r in QUERIES[name](spark, sf).select("image_ix").collect()) == sorted(keys)


def test_volume_holds_every_supplier(spark, tmp_path):
    spark.read.parquet(f"{SF}/supplier.parquet").selectExpr("s_suppkey * 500 as s_suppkey", "s_name", "s_nationkey", "s_acctbal").write.parquet(str(tmp_path / "supplier.parquet"))
    out = QUERIES["scatter_volume"](spark, str(tmp_path))
    assert out.where("value is not null").count() == spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_descriptors_of_many_suppliers_are_many_tasks(spark, tmp_path):
    one = spark.read.parquet("/root/testdata/sf0.01/supplier.parquet")
    many = one.crossJoin(spark.range(13)).selectExpr("s_suppkey + id * 100 as s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    many.coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    out = QUERIES["gist_features"](spark, str(tmp_path))
    rows = out.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.image_ix for r in rows) == list(range(1300))
    assert max(Counter(r.task for r in rows).values()) <= 512
    p = np.arange(32)
    for r in rows[::100]:
        x = (r.image_ix * 31 + p[:, None] ** 2 * 7 + p * 13 + p[:, None] * p) % 256
        assert np.allclose(r.f, K.gist(x[None].astype(float), most=0)[0], rtol=0, atol=6e-5)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 640
    assert set(entry.oracle_sql()) <= set(entry.queries())
