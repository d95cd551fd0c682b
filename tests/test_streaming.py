import shutil

from pyspark.sql import functions as F

from attnloom.schema import HEAD
from attnloom.streaming import features as S

SCHEMA = "run_id string, row_idx long, layer int, head int, w array<array<double>>"


def maps(spark, rows):
    return spark.createDataFrame(
        [("r", i, l, 0, [[1.0], [0.25, 0.75], [0.2, 0.3, 0.5]][: 2 + i % 2]) for i in rows for l in range(2)], SCHEMA
    )


def test_stream_equals_batch_and_repeats_change_nothing(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    maps(spark, range(6)).repartition(3).write.parquet(source)
    schema = maps(spark, [0]).schema
    S.run_available(spark, source, target, state, schema, files_per_batch=1)
    assert spark.read.parquet(target).count() == 12
    # late shards: two new examples, two that were there before, one of them twice
    maps(spark, [4, 5, 6, 7]).write.mode("append").parquet(source)
    maps(spark, [5]).write.mode("append").parquet(source)
    S.run_available(spark, source, target, state, schema)
    stored = spark.read.parquet(target)
    batch = S.head_features(maps(spark, range(8)))
    assert stored.count() == 16 == stored.select(*HEAD).distinct().count()
    columns = [*HEAD, "attn_diag", "lap_diag", F.round("log_det", 12)]
    assert stored.select(*columns).exceptAll(batch.select(*columns)).count() == 0


def test_replayed_batch_is_stored_once(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    maps(spark, range(5)).repartition(2).write.parquet(source)
    schema = maps(spark, [0]).schema
    S.run_available(spark, source, target, state, schema, files_per_batch=1)
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    lost = str(tmp_path / "lost")  # as if the driver had died before it noted the last batch
    shutil.copytree(state, lost, ignore=lambda folder, _: {str(last), f".{last}.crc"} if folder.endswith("commits") else set())
    S.run_available(spark, source, target, lost, schema, files_per_batch=1)
    stored = spark.read.parquet(target)
    assert stored.count() == 10 == stored.select(*HEAD).distinct().count()


def test_a_batch_reads_nothing_stored(spark, tmp_path):
    source = str(tmp_path / "in")
    maps(spark, range(3)).write.parquet(source)
    stream = S.first_of_each(S.head_features(S.read_shards(spark, source, maps(spark, [0]).schema)))
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "Deduplicate" in plan and "Join" not in plan


def test_watermark_bounds_the_state(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = maps(spark, range(3)).withColumn("at", F.timestamp_seconds("row_idx"))
    rows.write.parquet(source)
    read = S.read_shards(spark, source, rows.schema)
    plan = S.first_of_each(read, arrival="at", delay="10 seconds")._jdf.queryExecution().analyzed().toString()
    assert "DeduplicateWithinWatermark" in plan
