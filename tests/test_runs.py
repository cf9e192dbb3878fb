"""Publishing runs: failing and empty steps, crashes between both halves of a swap; and landing files with nanoseconds."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lakelineage.plans import medallion
from lakelineage.sources import files


@pytest.fixture
def schema(spark):
    spark.sql("CREATE SCHEMA IF NOT EXISTS swaps")
    yield "swaps"
    for t in spark.catalog.listTables("swaps"):
        spark.sql(f"DROP {'VIEW' if t.tableType == 'VIEW' else 'TABLE'} swaps.{t.name}")


def ids(spark, target):
    return sorted(r[0] for r in spark.table(target).collect())


def broken(spark):
    return spark.range(5).selectExpr("id", "CASE WHEN id = 4 THEN raise_error('no') END AS x")


def test_failing_and_empty_steps_keep_the_old_table(spark, schema):
    run, target = medallion.Run(spark), f"{schema}.t"
    assert run.step(target, lambda: spark.range(3)) and ids(spark, target) == [0, 1, 2]
    assert not run.step(target, lambda: broken(spark)) and ids(spark, target) == [0, 1, 2]
    assert not run.step(target, lambda: spark.range(0)) and ids(spark, target) == [0, 1, 2]
    assert not run.step(target, lambda: spark.table("swaps.gone")) and ids(spark, target) == [0, 1, 2]
    assert run.step(target, lambda: spark.range(2).selectExpr("id", "'x' AS more")) and spark.table(target).columns == ["id", "more"]
    assert [m[1:3] for m in run.metrics] == [("SUCCESS", 3), ("FAILED", 0), ("FAILED", 0), ("FAILED", 0), ("SUCCESS", 2)]
    assert "has no rows" in run.metrics[2][4]
    with pytest.raises(RuntimeError, match="swaps.t"):
        run.finish()
    assert run.step(target, lambda: spark.range(1)) and run.step(target, lambda: spark.table(target).selectExpr("id + 7 AS id"))
    assert ids(spark, target) == [7] and sorted(medallion.versions(spark, target)) == [3, 4]  # a step may read its own target


def test_a_plain_table_becomes_a_version(spark, schema):
    spark.range(4).write.saveAsTable("swaps.p")
    assert medallion.publish_version(spark, "swaps.p", spark.range(2)) == 2
    assert ids(spark, "swaps.p") == [0, 1] and ids(spark, "swaps.p__v0") == [0, 1, 2, 3]


def test_recovery_after_crashes(spark, schema):
    # After the plain table was renamed and before the view was made.
    spark.range(4).write.saveAsTable("swaps.c")
    spark.sql(f"ALTER TABLE swaps.c SET TBLPROPERTIES ('{medallion.CHECKED}' = 'true')")
    spark.sql("ALTER TABLE swaps.c RENAME TO swaps.c__v0")
    medallion.recover(spark, "swaps.c")
    assert ids(spark, "swaps.c") == [0, 1, 2, 3]
    # While a version was being written: it has no mark.
    spark.range(9).write.saveAsTable("swaps.c__v1")
    medallion.recover(spark, "swaps.c")
    assert sorted(medallion.versions(spark, "swaps.c")) == [0] and ids(spark, "swaps.c") == [0, 1, 2, 3]
    # After the check and before the view was set: the old version stays until the next step.
    spark.range(9).write.saveAsTable("swaps.c__v1")
    spark.sql(f"ALTER TABLE swaps.c__v1 SET TBLPROPERTIES ('{medallion.CHECKED}' = 'true')")
    assert medallion.publish_version(spark, "swaps.c", spark.range(1)) == 1 and ids(spark, "swaps.c") == [0]


@pytest.mark.parametrize("zone", ["UTC", "Asia/Tokyo"])
def test_nanosecond_landing(spark, tmp_path, zone):
    at = [1_700_000_000_123_456_789, -1, 0, None, 253_402_300_799_999_999]
    table = pa.table({"n": pa.array(range(5)), "z": pa.array(at, pa.timestamp("ns", "UTC")), "plain": pa.array(at, pa.timestamp("ns")), "us": pa.array([x and x // 1000 for x in at], pa.timestamp("us", "UTC"))})
    pq.write_table(table, tmp_path / "a.parquet", version="2.6")
    pq.write_table(table.slice(0, 1), tmp_path / "b.parquet", version="2.6")
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert files.nanosecond_columns(spark, str(tmp_path)) == {"z": True, "plain": False}
        df = files.landing(spark, str(tmp_path))
        assert [t for _, t in df.dtypes] == ["bigint", "timestamp", "timestamp", "timestamp"]
        got = {r[0]: r[1:] for r in df.where("n > 0").selectExpr("n", "unix_micros(z)", "cast(plain AS string)", "unix_micros(us)").collect()}
        first = df.where("n = 0").selectExpr("unix_micros(z)", "cast(plain AS string)", "unix_micros(us)").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
        spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "false")
    assert len(first) == 2 and first[0] == first[1] == (at[0] // 1000, "2023-11-14 22:13:20.123456", at[0] // 1000)
    for i in (1, 2, 4):
        text = (dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=at[i] // 1000)).strftime("%Y-%m-%d %H:%M:%S.%f").rstrip("0").rstrip(".")
        assert got[i] == (at[i] // 1000, text, at[i] // 1000)
    assert got[3] == (None, None, None)


def test_landing_without_nanoseconds(spark, tmp_path):
    spark.range(3).selectExpr("id", "timestamp_ntz'2020-01-01 00:00:00' AS t").write.parquet(str(tmp_path / "x"))
    df = files.landing(spark, str(tmp_path / "x"))
    assert df.count() == 3 and dict(df.dtypes)["t"] == "timestamp"
    with pytest.raises(ValueError):
        files.checked(df.limit(0), "x")
    assert files.checked(df, "x") is df
