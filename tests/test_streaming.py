"""Streams over folder tables, in many micro-batches whose files come in no order of time."""

import os

from pyspark.sql import functions as F

from emberline import streaming as ST
from emberline.session import ensure_checkpoint_dir, read_table
from emberline.streaming import scratch


def _shuffled(spark, sf_dir, files=40):
    """``events`` as a folder of many files, dealt without regard to time."""
    base = scratch(spark, "tables")
    events = read_table(spark, sf_dir, "events")
    events.repartition(files, F.xxhash64("event_id")).write.parquet(os.path.join(base, "events.parquet"))
    return base, events


def _drain(spark, base, name, result):
    stream = ST.stream_folder(spark, os.path.join(base, "events.parquet"), read_table(spark, base, "events").schema, files_per_batch=7)
    return ST.run_available_now(stream, name, result)


def test_folder_table_is_read_whole(spark, sf_dir):
    base, events = _shuffled(spark, sf_dir)
    out = ST.run_available_now(ST.stream_table(spark, base, "events"), "all")
    assert out.drop(ST.BATCH_ID).count() == events.count()


def test_import_loses_nothing_and_repeats_nothing(spark, sf_dir):
    base, events = _shuffled(spark, sf_dir)
    _drained = _drain(spark, base, "import", lambda b, known: ST.dedup_import(b.unionByName(b), known, "event_id"))
    assert _drained.select(ST.BATCH_ID).distinct().count() >= 4
    assert sorted(r[0] for r in _drained.select("event_id").collect()) == sorted(r[0] for r in events.select("event_id").collect())


def test_latest_and_counts_fold(spark, sf_dir):
    base, events = _shuffled(spark, sf_dir)
    want = ST.latest_stage(events, "user_id", "ts", "event_type", "event_id")
    got = ST.fold_latest(_drain(spark, base, "latest", lambda b, _: ST.latest_stage(b, "user_id", "ts", "event_type", "event_id")), "user_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    want = ST.tumbling_counts(events, "ts", ["event_type"])
    got = ST.fold_counts(_drain(spark, base, "counts", lambda b, _: ST.tumbling_counts(b, "ts", ["event_type"])), ["window_start", "window_end", "event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_shared_folder_is_named(spark):
    assert ensure_checkpoint_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def _by_days(spark, sf_dir, files=20, shuffled=False):
    """``events`` as ``files`` files in order of time, or dealt at random, each read in a batch of its own."""
    base = scratch(spark, "tables")
    events = read_table(spark, sf_dir, "events")
    path = os.path.join(base, "events.parquet")
    dealt = events.repartition(files, F.xxhash64("event_id")) if shuffled else events.repartitionByRange(files, "ts")
    dealt.sortWithinPartitions("ts").write.parquet(path)
    return ST.stream_folder(spark, path, events.schema, files_per_batch=1), events


class Killed(Exception):
    pass


def _killer(at):
    """Raises ahead of the write of batch ``at``, once."""
    done = []

    def before_write(batch_id):
        if batch_id == at and not done:
            done.append(batch_id)
            raise Killed

    return before_write


def _twice(run, name, spark):
    """Runs, is killed at batch 3, and is started again in the same folder."""
    base, killer = scratch(spark, name), _killer(3)
    try:
        run(base, killer)
    except Exception:  # noqa: BLE001 - the query's failure, wrapped by the stream
        pass
    return run(base, killer)


def test_killed_import_goes_on_without_loss_or_doubles(spark, sf_dir):
    stream, events = _by_days(spark, sf_dir, 8)
    out = _twice(lambda base, kill: ST.import_once(stream.unionByName(stream), "event_id", "import", base, kill), "import", spark)
    assert sorted(r[0] for r in out.select("event_id").collect()) == sorted(r[0] for r in events.select("event_id").collect())
    assert out.select(ST.BATCH_ID).distinct().count() >= 8


def test_killed_latest_stages_go_on(spark, sf_dir):
    stream, events = _by_days(spark, sf_dir, 8, shuffled=True)
    parts = _twice(lambda base, kill: ST.latest_stages(stream, "user_id", "ts", "event_type", "event_id", "latest", base, kill), "latest", spark)
    want = ST.latest_stage(events, "user_id", "ts", "event_type", "event_id")
    assert sorted(map(tuple, ST.last_states(parts, "user_id").collect())) == sorted(map(tuple, want.collect()))


def test_batches_read_their_own_rows_alone(spark, sf_dir):
    stream, events = _by_days(spark, sf_dir, 20)
    progress = ST._drain(ST.latest_stage(stream, "user_id", "ts", "event_type", "event_id"), "rows", scratch(spark, "rows"), "update",
                         lambda batch, n: batch.write.format("noop").mode("overwrite").save())
    read = [p["numInputRows"] for p in progress if p["numInputRows"]]
    assert len(read) == 20 and sum(read) == events.count() and max(read) < 2 * min(read)


def test_windows_close_once_and_late_rows_are_corrections(spark, sf_dir):
    keys = ["window_start", "window_end", "event_type"]
    for shuffled in (False, True):
        stream, events = _by_days(spark, sf_dir, 10, shuffled)
        tables = _twice(lambda base, kill, s=stream: ST.closing_counts(s, "ts", ["event_type"], "1 day", "1 day", "w", base, kill), "w", spark)
        assert tables["closed"].groupBy(*keys).count().where("count > 1").count() == 0
        got, want = ST.all_counts(tables, keys), ST.tumbling_counts(events, "ts", ["event_type"])
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert tables["closed"].count() > 0
        if not shuffled:
            continue
        # Every file has late rows, and what a batch hands on is bounded by the delay, not by the batches before it.
        assert tables["corrections"].count() > 0
        days = tables["open"].groupBy(ST.BATCH_ID).agg(F.countDistinct("window_start").alias("n")).agg(F.max("n")).first()[0]
        assert days <= 4
