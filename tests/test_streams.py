"""Streams end to end on small files."""

import pandas as pd
import pytest

from stratafold import fixtures as fx
from stratafold.sources import versions
from stratafold.streaming import edits as st

FOLDER = "/root/testdata/sf0.001"


def test_edit_log_drops_repeated_deliveries(spark, tmp_path):
    batch = fx.edits(spark, FOLDER).selectExpr("stem", "y", "x", "action", "cast(logged_at as timestamp) as logged_at")
    source = str(tmp_path / "in")
    for _ in range(2):
        batch.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(batch.schema).parquet(source)
    st.append_log(stream, str(tmp_path / "log"), str(tmp_path / "ck"), "1000 days").awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == batch.distinct().count()


def test_summary_stream_is_idempotent(spark, tmp_path):
    path, history = str(tmp_path / "summary"), str(tmp_path / "history")
    run = spark.createDataFrame(pd.DataFrame({"image": ["a", "a", "b"], "region": ["CMM", "CMM", "CMM"], "n": [1, 2, 5],
                                              "counted_at": pd.to_datetime(["2024-01-01", "2024-01-02", "2024-01-01"])}))
    source = str(tmp_path / "in")
    run.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(run.schema).parquet(source)
    st.keep_summary(stream, path, history, str(tmp_path / "ck")).awaitTermination()
    assert {(r.image, r.n) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 5)}
    st.upsert_batch(spark, run, 0, path, history)
    assert spark.read.parquet(path).count() == 2 and spark.read.parquet(history).count() == 2


def test_poll_reads_what_is_there(spark, tmp_path):
    spark.range(7).write.parquet(str(tmp_path / "r"))
    stream, trigger = st.poll_results(spark, str(tmp_path / "r"), "id long", None)
    stream.writeStream.format("memory").queryName("polled").trigger(**trigger).start().awaitTermination()
    assert spark.sql("SELECT count(*) AS n FROM polled").first().n == 7


@pytest.fixture
def summary(spark, tmp_path):
    rows = spark.createDataFrame([(i, r, i * 10) for i in range(40) for r in ("a", "b")], "image long, region string, n long")
    path = str(tmp_path / "summary")
    versions.write_version(rows, path, buckets=8)
    return path


def test_a_run_on_one_image_rewrites_one_partition_and_a_repeat_nothing(spark, summary):
    run = spark.createDataFrame([(7, "a", -1)], "image long, region string, n long")
    before = versions._manifest(spark, summary, 1)["parts"]
    assert versions.upsert(run, summary)["rewritten"] == 1
    after = versions._manifest(spark, summary, 2)["parts"]
    assert sum(before[p] != after[p] for p in before) == 1
    assert versions.upsert(run, summary) == {"version": 2, "kept": versions.upsert(run, summary)["kept"], "replaced": 1, "rewritten": 0}
    now = versions.read_version(spark, summary)
    assert now.filter("image = 7").collect() == [(7, "a", -1)] and now.count() == 79 and versions.read_version(spark, summary, 1).count() == 80


def test_a_reader_finds_a_version_whenever_the_writer_stops(spark, summary, monkeypatch):
    run = spark.createDataFrame([(1, "a", 5, "new")], "image long, region string, n long, note string")
    commit = versions._commit

    def stop(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(versions, "_commit", stop)  # after the data, before the version
    with pytest.raises(KeyboardInterrupt):
        versions.upsert(run, summary)
    assert versions.read_version(spark, summary).count() == 80
    monkeypatch.setattr(versions, "_commit", commit)
    versions.upsert(run, summary)
    got = versions.read_version(spark, summary)
    assert got.count() == 79 and got.filter("note = 'new'").count() == 1 and got.filter("note IS NULL").count() == 78


def test_of_two_writers_one_wins(spark, summary):
    with pytest.raises(versions.Conflict):
        versions._commit(spark, summary, 1, {})
    assert versions.read_version(spark, summary).count() == 80
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, summary + "-none")


def test_expired_versions_leave_the_newer_ones_whole(spark, summary):
    for n in range(3):
        versions.upsert(spark.createDataFrame([(n, "a", 100 + n)], "image long, region string, n long"), summary)
    assert versions.expire(spark, summary, keep=1) > 0
    assert versions.versions(spark, summary) == [4] and versions.read_version(spark, summary).count() == 77


def test_a_run_written_again_is_once_in_the_history(spark, tmp_path):
    for _ in range(2):
        versions.append_run(spark.range(3), str(tmp_path / "h"), "r1")
    versions.append_run(spark.range(2), str(tmp_path / "h"), "r2")
    assert spark.read.parquet(str(tmp_path / "h")).count() == 5
