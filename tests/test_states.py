"""Rules over task states with nulls, ties and empty tables."""

from quillspark.operators import states as st

LOG = "url string, at int, status string, version int"


def test_null_statuses_versions_and_keys(spark):
    rows = [("a", 1, "ok", 2), ("a", 2, None, None), ("a", 3, "ok", 1), ("a", 4, "failed", 3), (None, 5, "ok", 1), (None, 6, "ok", 1)]
    log = spark.createDataFrame(rows, LOG)
    assert sorted(r["at"] for r in st.terminal_changes(log, "url", ["at"], "status").collect()) == [1, 4, 5]
    assert sorted(r["at"] for r in st.accepted_writes(log, "url", ["at"], "version").collect()) == [1, 4, 5]
    assert sorted(r["at"] for r in st.first_tasks(log, "url", ["at"]).collect()) == [1, 5]


def test_ring_goes_on_after_the_cursor(spark):
    log = spark.createDataFrame([(key, k, "ok", k) for key in ("a", None) for k in range(12)], LOG)
    kept = sorted((r["url"] or "", r["cursor"], r["at"]) for r in st.ring(log, "url", ["at"], 5).collect())
    assert kept == [(key, k + 1, k) for key in ("", "a") for k in range(7, 12)]


def test_skip_after_a_streak(spark):
    statuses = ["failed", "failed", "failed", "ok", "failed"]
    log = spark.createDataFrame([("a", k, s, 0) for k, s in enumerate(statuses)], LOG)
    assert [r["at"] for r in st.fast_skips(log, "url", ["at"], log["status"] == "failed").collect()] == [3]


def test_empty_log(spark):
    log = spark.createDataFrame([], LOG + ", t timestamp")
    found = (st.terminal_changes(log, "url", ["at"], "status"), st.accepted_writes(log, "url", ["at"], "version"), st.first_tasks(log, "url", ["at"]), st.ring(log, "url", ["at"]), st.fresh(log, "url", ["at"], "t"), st.decayed_rate(log, "url", log["t"].cast("date"), log["status"] == "ok"))
    assert all(df.count() == 0 for df in found)
