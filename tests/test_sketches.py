"""Distinct counts from kept sketches: decisions of exact counts, and old files left unread."""

from pyspark.sql import functions as F

from tallyspark.operators import sketches


def _decide(df, columns):
    return {r["column_name"]: r for r in sketches.distinct_decisions(sketches.sketch_columns(df, columns), df).collect()}


def test_decisions_equal_exact_counts(spark):
    n = 10_000
    rows = spark.range(n).select(
        *[(F.col("id") % d).cast("string").alias(f"c{d}") for d in (1, 2, 3, 4000, 7900, 7999, 8000, 8001, 8100, 10_000)],
        F.when(F.col("id") % 2 == 0, F.col("id") % 3).alias("gaps"), F.lit(None).cast("string").alias("none"),
        F.when(F.col("id") % 3 == 0, "").otherwise((F.col("id") % 3).cast("string")).alias("blank"),
    )
    found = _decide(rows, rows.columns)
    for name in rows.columns:
        exact = rows.agg(F.count_distinct(name).alias("n")).first()["n"]
        assert found[name]["suits"] == (2 < exact < 0.8 * n), name
        assert abs(found[name]["n_estimate"] - exact) <= sketches.MARGIN * max(exact, 1)
    assert [found[c]["counted"] for c in ("c4000", "c7999", "c8000", "c10000")] == [False, True, True, False]
    assert found["gaps"]["n_values"] == n // 2 and found["none"]["n_values"] == 0 and found["blank"]["suits"]


def test_tables_without_rows_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "a string, b int")
    assert all(not r["suits"] for r in _decide(empty, ["a", "b"]).values())
    rows = spark.createDataFrame([("x", 1)] * 50 + [("y", 2)] * 30 + [("z", 3)], "a string, file_key int")
    assert {c: r["suits"] for c, r in _decide(rows, ["a", "file_key"]).items()} == {"a": True, "file_key": True}


def test_only_new_files_are_read(spark, tmp_path):
    folder, store = str(tmp_path / "up loads+1%25é"), str(tmp_path / "store")

    def upload(first, last):
        spark.range(first, last, numPartitions=1).select((F.col("id") % 700).cast("string").alias("code")).write.mode("append").parquet(folder)

    def facts():
        now = sketches.refresh_sketches(spark, folder, store, ["code"])
        return sketches.distinct_decisions(now, spark.read.parquet(folder)).first()

    upload(0, 500)
    assert sketches.new_files(spark, folder, store).count() == 1
    assert (facts()["n_rows"], sketches.new_files(spark, folder, store).count()) == (500, 0)
    upload(400, 1500)
    left = sketches.new_files(spark, folder, store)
    assert left.count() == 1
    second = facts()
    assert (second["n_rows"], second["suits"]) == (1600, True) and abs(second["n_estimate"] - 700) <= sketches.MARGIN * 700
    # A retried run that lost its place writes the same rows again, and a file that is gone no longer counts.
    assert facts() == second and sketches.read_store(spark, store).count() == 2
    spark.range(10).select(F.col("id").cast("string").alias("code")).coalesce(1).write.mode("overwrite").parquet(folder)
    assert facts()["n_rows"] == 10
