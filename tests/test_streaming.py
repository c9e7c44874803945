import pytest

from landgauge.streaming import landing
from landgauge.streaming.landing import committed_versions, latest_version, merge_batch, retire, stream_upsert

ROW = "k int, v string, at int"


def land(spark, source, table, checkpoint):
    stream = spark.readStream.schema(ROW).json(source)
    stream_upsert(stream, table, ["k"], "at", checkpoint).awaitTermination()


def rows(spark, table):
    return sorted(map(tuple, latest_version(spark, table).collect()))


def test_a_fresh_checkpoint_keeps_the_table(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], ROW).write.json(source)
    land(spark, source, table, str(tmp_path / "c1"))
    spark.createDataFrame([(2, "c", 2), (3, "d", 1)], ROW).write.mode("append").json(source)
    land(spark, source, table, str(tmp_path / "c1"))
    want = [(1, "a", 1), (2, "c", 2), (3, "d", 1)]
    assert rows(spark, table) == want
    # everything is read again from the start, on top of the table
    land(spark, source, table, str(tmp_path / "c2"))
    assert rows(spark, table) == want
    # a version whose manifest was not written is not read
    (tmp_path / "table" / "manifest" / "batch=99").mkdir()
    assert committed_versions(spark, table)[-1] < 99
    assert rows(spark, table) == want


def test_a_small_update_rewrites_its_buckets_only(spark, tmp_path):
    table = str(tmp_path / "t")
    merge_batch(spark.range(5000).selectExpr("cast(id as int) as k", "'old' as v", "1 as at"), table, ["k"], "at", buckets=128)
    touched = merge_batch(spark.createDataFrame([(7, "new", 2), (8, "late", 0), (6000, "more", 1)], ROW), table, ["k"], "at")
    assert 1 <= len(touched) <= 3
    written = [p.name for p in (tmp_path / "t" / "data" / "batch=1").glob("_bucket=*")]
    assert len(written) == len(touched)
    got = {k: v for k, v, _ in rows(spark, table)}
    assert len(got) == 5001 and got[7] == "new" and got[8] == "old" and got[6000] == "more"
    assert merge_batch(spark.createDataFrame([], ROW), table, ["k"], "at") == [] and committed_versions(spark, table) == [0, 1]


def test_a_write_cut_short_leaves_the_table_and_is_done_again(spark, tmp_path, monkeypatch):
    table, batch = str(tmp_path / "t"), spark.createDataFrame([(1, "b", 2), (2, "c", 2)], ROW)
    merge_batch(spark.createDataFrame([(1, "a", 1)], ROW), table, ["k"], "at", buckets=4)
    with monkeypatch.context() as m:
        # the data are written, the manifest is not
        m.setattr(spark.__class__, "createDataFrame", lambda *a, **b: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            merge_batch(batch, table, ["k"], "at")
    assert (tmp_path / "t" / "data" / "batch=1").exists() and rows(spark, table) == [(1, "a", 1)]
    merge_batch(batch, table, ["k"], "at")
    assert rows(spark, table) == [(1, "b", 2), (2, "c", 2)]


def test_old_buckets_are_retired(spark, tmp_path):
    table = str(tmp_path / "t")
    for at in range(4):
        merge_batch(spark.createDataFrame([(1, f"v{at}", at), (100 + at, "x", at)], ROW), table, ["k"], "at", buckets=8)
    want = rows(spark, table)
    before = len(list((tmp_path / "t" / "data").glob("batch=*/_bucket=*")))
    assert retire(spark, table) > 0 and rows(spark, table) == want
    assert len(list((tmp_path / "t" / "data").glob("batch=*/_bucket=*"))) < before
    assert committed_versions(spark, table) == [2, 3] and retire(spark, table) == 0
    assert landing.KEPT_VERSIONS == 2
