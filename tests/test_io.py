import pytest

from pyspark.sql import functions as F

from platelab.sources import catalog, readers, writers
from platelab.streaming.incremental import append_stream


def test_catalog():
    places = {"stage1/snapshots": "/s", "stage1/snapshots/x.csv": "/x"}
    assert catalog.resolve("stage1/snapshots/x.csv", places, "/r") == "/x"
    assert catalog.resolve("stage1/snapshots/y/z.csv", places, "/r") == "/s/y/z.csv"
    assert catalog.resolve("other.csv", places, "/r") == "/r/other.csv"
    assert catalog.version_path("vocab", 3) == "vocab/v=03"


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,zip\n1,5,01234\nx,6,2\n3,,3\n")
    got = readers.csv(spark, f"{tmp_path}/*.csv", {"id": "long", "n": "long", "zip": "string"}, ("id", "n")).collect()
    assert [tuple(r) for r in got] == [(1, 5, "01234")]
    (tmp_path / "a.jsonl").write_text('{"id": 1, "v": "a"}\nnot json\n{"id": 1, "v": "b", "error": "e"}\n{"id": 2, "v": "c", "error": ""}\n')
    rows = readers.jsonl(spark, f"{tmp_path}/a.jsonl", "id long, v string, error string")
    assert rows.count() == 3
    assert readers.jsonl(spark, f"{tmp_path}/a.jsonl", "id long, v string, error string", skip_errors=True).count() == 2
    assert {tuple(r) for r in readers.keyed(rows, "id", {"w": "v"}, "v").collect()} == {(1, "b"), (2, "c")}


def test_writers(spark, tmp_path):
    x = spark.range(10).toDF("k").withColumn("v", F.col("k") * 2)
    out = f"{tmp_path}/out"
    writers.append_new(x.where("k < 5"), out, "k")
    writers.append_new(x, out, "k")
    writers.append_new(x, out, "k")
    assert writers.appended(spark, out).count() == 10 and len(writers.runs(spark, out)) == 3
    writers.sharded_json(x, f"{tmp_path}/shards", "k", 4)
    assert spark.read.json(f"{tmp_path}/shards").select("shard").distinct().count() == 4
    writers.sorted_csv(x, f"{tmp_path}/csv", F.desc("v"))
    writers.clustered(x, f"{tmp_path}/clustered", "k")
    assert readers.cached(spark, f"{tmp_path}/clustered", lambda: None).count() == 10
    first, missing = writers.merge_shards(x.where("k < 2"), [x.where("k < 4").withColumn("v", F.lit(-1).cast("long")), x.where("k < 6").withColumn("v", F.lit(-2).cast("long"))], x.select("k"), "k")
    assert {tuple(r) for r in first.collect()} == {(0, 0), (1, 2), (2, -1), (3, -1), (4, -2), (5, -2)} and missing.count() == 4
    assert tuple(writers.manifest(x, x, 4).first()) == (10, 10, 4)


def test_stream_appends_once(spark, tmp_path):
    x = spark.range(10).toDF("k")
    x.write.parquet(f"{tmp_path}/in")
    for k in range(2):
        append_stream(spark.readStream.schema("k long").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c{k}", "k").awaitTermination(120)
    assert writers.appended(spark, f"{tmp_path}/out").count() == 10


def test_runs_are_whole_or_not_there(spark, tmp_path):
    out = f"{tmp_path}/out"
    x = spark.range(2000).selectExpr("id AS k", "id % 7 AS l", "repeat('x', 50) AS v")
    assert writers.appended(spark, out) is None
    writers.append_new(x.where("k < 1000"), out, "k", "l", run="first")
    failing = x.withColumn("v", F.when(F.col("k") == 1500, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    for _ in range(2):
        with pytest.raises(Exception):
            writers.append_new(failing, out, "k", "l", run="second")
    (tmp_path / "out" / "append_run=second" / "append_bucket=0").mkdir(parents=True)
    (tmp_path / "out" / "append_run=second" / "append_bucket=0" / "half.parquet").write_bytes(b"PAR1")
    assert writers.runs(spark, out) == ["first"] and writers.appended(spark, out).count() == 1000
    writers.append_new(x, out, "k", "l", run="second")
    writers.append_new(x.withColumn("v", F.lit("new")), out, "k", "l", run="second")
    writers.append_new(x, out, "k", "l", run="third")
    assert writers.runs(spark, out) == ["first", "second", "third"]
    got = writers.appended(spark, out)
    assert got.count() == 2000 and got.select("k", "l").distinct().count() == 2000 and got.where("v = 'new'").isEmpty()


def test_a_run_reads_few_of_the_bytes(spark, tmp_path):
    out = f"{tmp_path}/out"
    writers.append_new(spark.range(20000).selectExpr("id AS k", "repeat(md5(CAST(id AS STRING)), 20) AS v"), out, "k")
    held = writers.appended(spark, out)
    few = spark.range(19998, 20003).select(F.pmod(F.xxhash64("id"), F.lit(64)).cast("int").alias("append_bucket"))
    part = held.where(F.col("append_bucket").isin([r[0] for r in few.collect()])).select("k")
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [append_bucket" in scan and "ReadSchema: struct<k:bigint>" in scan
    files = {f for (f,) in part.select(F.input_file_name()).distinct().collect()}
    assert len(files) <= 5 and len(held.inputFiles()) == 64
