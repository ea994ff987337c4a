"""Streams over small directories: repeats, new filings between runs, refreshed partitions."""

from pyspark.sql import functions as F

from filigree.operators import filings as D
from filigree.streaming import streams


def rows(spark):
    data = [(1, "a", "h1", "2024-01-01", "2023-12-31"), (1, "a", "h1", "2024-01-02", "2023-12-31"), (1, "b", "h2", "2024-02-01", "2024-01-31"), (2, "c", "h3", "2024-02-01", "2024-01-31")]
    df = spark.createDataFrame(data, "issuer_id int, accession string, content_hash string, filed_at string, period_end string")
    return df.withColumns({"filed_at": F.to_timestamp("filed_at"), "period_end": F.to_date("period_end"), "form_type": F.lit("10-Q")})


def test_intake_drops_repeats(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows(spark).schema).parquet(str(tmp_path / "in"))
    streams.filing_intake(stream, str(tmp_path / "out"), str(tmp_path / "progress"))
    assert sorted(r["accession"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_intake_goes_on_where_the_last_run_ended(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    for accessions in ("ab", "c", "", "ad"):
        if accessions:
            rows(spark).dropDuplicates(["accession"]).unionByName(rows(spark).where("accession = 'c'").withColumn("accession", F.lit("d"))).where(F.col("accession").isin(list(accessions))).write.mode("append").parquet(source)
        streams.filing_intake(spark.readStream.schema(rows(spark).schema).parquet(source), target, progress, "90 days")
    assert sorted(r["accession"] for r in spark.read.parquet(target).collect()) == ["a", "b", "c", "d"]


def test_refresh_touches_only_new_issuers(spark, tmp_path):
    every = rows(spark).dropDuplicates(["accession"])
    target, source, progress = (str(tmp_path / n) for n in ("edges", "new", "progress"))
    spark.createDataFrame([("x", "y", "NEXT", 1), ("x", "y", "NEXT", 3)], "source_id string, target_id string, edge_type string, issuer_id int").write.partitionBy("issuer_id").parquet(target)
    built = []

    def edges(some):
        built.append({r["issuer_id"] for r in some.select("issuer_id").distinct().collect()})
        return D.temporal_edges(some).withColumn("issuer_id", F.lit(1))

    for issuers in ([1], [2]):
        every.where(F.col("issuer_id").isin(issuers)).write.mode("append").parquet(source)
        streams.snapshot_refresh(spark.readStream.schema(every.schema).parquet(source), lambda: every, target, progress, edges)
    assert built == [{1}, {2}]  # the second run rebuilds the issuer that came in between alone
    assert {(r["issuer_id"], r["source_id"]) for r in spark.read.parquet(target).where("issuer_id = 3").collect()} == {(3, "x")}


def test_changes_in_three_batches_with_a_late_row(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "event_id long, user_id long, event_type string, ts string"
    read = lambda: streams.hourly(spark.readStream.schema("event_id long, user_id long, event_type string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source))
    key, now = ["window_start", "status"], lambda: sorted((str(r["window_start"]), r["status"], r["n"]) for r in streams.kept(spark, target, ["window_start", "status"], read().schema).collect())
    spark.createDataFrame([], schema).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    assert streams.kept(spark, target, key, read().schema).count() == 0
    late = []
    for batch in (
        [(1, 1, "ok", "2024-01-01 10:05:00"), (2, 1, "ok", "2024-01-01 10:55:00"), (3, 2, "bad", "2024-01-01 11:00:00")],
        [(4, 1, "ok", "2024-01-01 10:59:59"), (5, 2, "ok", "2024-01-10 00:00:00")],
        [(6, 1, "ok", "2024-01-01 10:30:00"), (7, 1, "bad", "2024-01-09 12:00:00")],  # the first is nine days late
    ):
        spark.createDataFrame(batch, schema).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(source)
        late.append(streams.keep_changes(read(), target, progress))
    want = [("2024-01-01 10:00:00", "ok", 3), ("2024-01-01 11:00:00", "bad", 1), ("2024-01-09 12:00:00", "bad", 1), ("2024-01-10 00:00:00", "ok", 1)]
    assert now() == want and late == [0, 0, 1]
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]) if "=" in p.name and any(spark.read.parquet(str(p)).take(1)) else -1)
    assert {r["n"] for r in spark.read.parquet(str(last)).collect()} == {1}  # only what changed
    assert streams.keep_changes(read(), target, progress) == 0 and now() == want


def test_last_of_users_goes_on(spark, tmp_path):
    source, target, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    schema = "event_id long, user_id long, event_type string, ts timestamp"
    seen = {}
    for rows in ([(1, 1, "a", "2024-01-02"), (2, 2, "b", "2024-01-01")], [(3, 1, "c", "2024-01-01"), (4, 2, "d", "2024-01-01")]):
        spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(source)
        stream = streams.last_of_users(spark.readStream.schema(schema).parquet(source))
        streams.keep_changes(stream, target, progress)
        seen = {r["user_id"]: r["event_type"] for r in streams.kept(spark, target, ["user_id"], stream.schema).collect()}
    assert seen == {1: "a", 2: "d"}
