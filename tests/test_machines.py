"""State machines as streams that fail in the middle of the input and are started again, against their batch twins; snapshots."""

import pytest
from pyspark.sql import functions as F

from quillspark.operators import catalogs, states as st
from quillspark.plans import catalog, state_queries as sq
from quillspark.sources.snapshots import SnapshotStore, accumulate
from quillspark.streaming import machines as m, monitors

SF = "/root/testdata/sf0.001"
ORDER = sq.ORDER


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """The log in six files, in order of time."""
    root = str(tmp_path_factory.mktemp("log"))
    log = sq._log(spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    cuts = [r.event_id for r in log.orderBy(*ORDER).select("event_id").collect()]
    step = len(cuts) // 6 + 1
    for k in range(6):
        log.where(F.col("event_id").isin(cuts[k * step : (k + 1) * step])).coalesce(1).write.parquet(f"{root}/{k}")
    return root, log


def stream(spark, parts):
    root, log = parts
    return spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(root)


def broken_then_whole(df, folder):
    """What a stream leaves that fails at its fourth batch, after its state has moved, and is started again."""

    def fail(batch, number):
        batch.write.mode("overwrite").parquet(f"{folder}/rows/{number}")
        if number == 3:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        df.writeStream.outputMode("append").foreachBatch(fail).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return monitors.run_once(df, folder)


CASES = {
    "terminals": (lambda: m.Terminals(ORDER), "url", lambda log: st.terminal_changes(log, "url", ORDER, "status")),
    "writes": (lambda: m.Writes(ORDER), "url", lambda log: st.accepted_writes(log, "url", ORDER, "version")),
    "skips": (lambda: m.Skips(ORDER, 2), "url", lambda log: st.fast_skips(log, "url", ORDER, F.col("status") != "ok", 2)),
    "fresh": (lambda: m.Fresh(ORDER, 86_400_000_000), "url", lambda log: st.fresh(log, "url", ORDER, "ts", 86_400.0)),
    "cooling": (lambda: m.Cooling(ORDER, 7_200_000_000), "domain", lambda log: catalogs.cooling(log, seconds=7200)),
    "tasks": (lambda: m.Tasks(ORDER), "domain", lambda log: st.task_ids(log, "url", ORDER, "event_id", "status")),
    "ring": (lambda: m.Ring(ORDER, 4), "url", lambda log: st.ring(log, "url", ORDER, 4)),
    "notices": (lambda: m.Notices(ORDER, 4), "domain", lambda log: st.notices(log, "domain", ORDER, ["url", "status"], 4)),
}


@pytest.mark.parametrize("name,late", [*((name, None) for name in CASES), ("fresh", "1 hour"), ("cooling", "1 hour")])
def test_restart_in_the_middle(spark, parts, tmp_path, name, late):
    machine, key, batch = CASES[name]
    got = broken_then_whole(m.run(stream(spark, parts), key, machine(), late), str(tmp_path))
    got = m.latest(got, key) if name in ("ring", "notices") else got
    want = batch(parts[1]).select(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def machine_rows(machine, rows):
    state, out = machine.start, []
    for row in rows:
        state, values = machine.step(state, row)
        out += [values] if values else []
    return out


def test_tiers_and_breaker_with_the_usual_values():
    s = 1_000_000
    row = lambda k, t, result: {"domain": "d", "event_id": k, "at": t * s, "result": result}
    failed = [row(k, k, "failed") for k in range(9)]
    good = [row(9 + k, 9 + k * 10, "ok") for k in range(40)]
    told = [(v[1], v[3], v[4]) for v in machine_rows(m.Tiers(ORDER), failed + good)]
    assert told == [(2, 2, "down"), (5, 1, "down"), (8, 0, "down"), (38, 1, "up")]  # 30 in a row, and 180 s after the last failure
    early = [row(9 + k, 9 + k, "ok") for k in range(220)]
    assert [v[1] for v in machine_rows(m.Tiers(ORDER), failed + early)][3:] == [188, 218]  # not before 180 s, then after 30 more
    opened = machine_rows(m.Breaker(ORDER), [row(k, k, "failed") for k in range(5)] + [row(5, 600, "ok"), row(6, 1300, "ok"), row(7, 1301, "failed")])
    assert [(v[2] // s, v[3] // s) for v in opened] == [(4, 604), (600, 1200)]


def test_null_and_late_rows(spark, tmp_path):
    rows = [("u", 1, "2024-01-01 00:00:00", "ok"), (None, 2, "2024-01-01 00:00:00", "failed"), ("u", 3, None, None), ("u", 4, "2024-01-02 00:00:00", "ok")]
    log = spark.createDataFrame(rows, "url string, event_id long, ts string, status string").withColumn("ts", F.to_timestamp("ts"))
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    got = monitors.run_once(m.run(spark.readStream.schema(log.schema).parquet(f"{tmp_path}/in"), "url", m.Terminals(ORDER)), f"{tmp_path}/out")
    assert sorted((r.url or "", r.event_id) for r in got.collect()) == [("", 2), ("u", 1)]


def test_streams_of_the_response_cache_and_run_once(spark, parts, tmp_path):
    df = monitors.once(stream(spark, parts), "url", "20 seconds")
    got = broken_then_whole(df.select("url", "event_id"), str(tmp_path))
    assert got.count() >= parts[1].select("url").distinct().count()
    again = monitors.run_once(df.select("url", "event_id"), str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))


def test_two_step_after_a_restart(spark, parts, tmp_path):
    log = stream(spark, parts)
    signs = log.where("event_type = 'view'").select("url", "ts", F.col("event_id").alias("sign_id"))
    df = m.two_step(signs, log.where("event_type = 'click'").select("url", "ts", "event_id"), "url", "2 days", "3 days").select("url", "event_id", "sign_id")
    got = {tuple(r) for r in broken_then_whole(df, str(tmp_path)).collect()}
    b, a = parts[1].where("event_type = 'click'"), parts[1].where("event_type = 'view'").select("url", F.col("ts").alias("t"), F.col("event_id").alias("sign_id"))
    want = b.join(a, "url").where("t <= ts and ts <= t + interval 2 days").select("url", "event_id", "sign_id")
    assert got == {tuple(r) for r in want.collect()} and got


def test_snapshots(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path), "book")
    assert store.load() is None and store.version() == -1
    df = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    read = lambda s=store: sorted(r.x for r in s.load().collect())
    assert store.save(df(1, 2), 5) and read() == [1, 2]
    assert not store.save(df(9), 5) and not store.save(df(9), 4) and read() == [1, 2]
    assert store.save(store.load().unionByName(df(3)), 6) and read() == [1, 2, 3]
    assert SnapshotStore(spark, str(tmp_path), "another").load() is None
    for v in range(7, 12):
        assert store.save(df(v), v)
    store.keep(2)
    assert store.versions() == [11, 10] and read() == [11]
    pointer = next(p for p in (tmp_path / "pointers").iterdir() if p.name.endswith("11.json"))
    whole = pointer.read_text()
    for crc in (tmp_path / "pointers").glob(".*.crc"):
        crc.unlink()
    for damaged in ("", whole[: len(whole) // 2], "[1]", '{"owner": "book"}'):
        pointer.write_text(damaged)
        assert store.load() is None
    pointer.write_text(whole)
    assert read() == [11]
    for f in (tmp_path / "data").glob("*11-*/part*"):
        f.write_bytes(b"no parquet")
    for f in (tmp_path / "data").glob("*11-*/.*.crc"):
        f.unlink()
    assert store.load() is None


def test_snapshots_of_a_stream_that_fails(spark, parts, tmp_path):
    store = SnapshotStore(spark, f"{tmp_path}/store", "events")
    calls = []

    def merge(old, batch):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("lost")
        return sq.merged_history(old, batch)

    with pytest.raises(Exception, match="lost"):
        accumulate(stream(spark, parts), store, merge, f"{tmp_path}/checkpoint").awaitTermination()
    assert store.version() == 1
    accumulate(stream(spark, parts), store, merge, f"{tmp_path}/checkpoint").awaitTermination()
    want = sq.merged_history(None, parts[1])
    assert sorted(map(tuple, store.load().collect())) == sorted(map(tuple, want.collect()))


def test_registered():
    assert {"stream_terminals", "stream_ring", "stream_tiers", "stream_breaker", "site_history"} <= set(catalog.oracle_sql())
