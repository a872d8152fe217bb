"""State machines over crawl logs as stateful streams, one state per task, URL or site.

A machine sees the rows of its key one after another: those of one trigger in the order of its
columns `order`, those of a later trigger after them. What it knows of a key is a few numbers, a
bounded list or a map, kept in the state store, so a stream that is stopped and started again goes
on where its checkpoint stands. Rows of a key and trigger are sorted in memory, as columns of those values
only that the machine reads: numbers packed, equal texts once. Bound triggers by the source's
maxFilesPerTrigger or maxBytesPerTrigger.

Where `late` is given it is the watermark's delay: rows later than that are dropped, and the state of
a key goes by a timer once the watermark has passed its last row by the machine's own span. Without
it states stay. Times are microseconds (column `at`, see `timed`). Each machine has a batch twin in
`quillspark.operators` with the same rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TERMINAL = ("ok", "failed", "stopped")


def with_state_store(spark: SparkSession) -> SparkSession:
    """The session, with the state store that these machines need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return spark


def timed(log: DataFrame, ts: str = "ts") -> DataFrame:
    """`log` with `at`, its time in microseconds."""
    return log.withColumn("at", F.unix_micros(F.col(ts).cast("timestamp")))


def _added(column, value, known: dict):
    """`column` with the value: an array as long as all are 64-bit integers, else a list in which equal values are one object."""
    if isinstance(column, array):
        if type(value) is int and -(1 << 63) <= value < 1 << 63:
            column.append(value)
            return column
        column = list(column)
    column.append(known.setdefault(value, value) if isinstance(value, str) else value)
    return column


def in_order(rows: Iterator[Row], order: list[str], reads: tuple[str, ...] | None) -> Iterator[dict]:
    """The rows by the columns `order`, nulls first, with the values named in `reads` (all if None)."""
    columns, known, n = {}, {}, 0
    for row in rows:
        if not n:
            names = list(dict.fromkeys([*order, *(row.__fields__ if reads is None else reads)]))
            columns = {c: array("q") for c in names}
        for c in names:
            columns[c] = _added(columns[c], row[c], known)
        n += 1
    index = array("q", range(n))
    for c in reversed(order if n else []):
        held = columns[c]
        index = array("q", sorted(index, key=held.__getitem__ if isinstance(held, array) else lambda i: (held[i] is not None, held[i])))  # noqa: B023
    for i in index:
        yield {c: held[i] for c, held in columns.items()}


class Machine(StatefulProcessor):
    """One tuple of state a key. A subclass gives `held`, `start`, `out` and `step(state, row) -> (state, values or None)`;
    `span_us`, the time after which a key's state means nothing any more, may be None. `reads` names the columns that it uses; None
    stands for all."""

    held = "seen boolean"
    start: tuple = (False,)
    out = ""
    span_us: int | None = None
    reads: tuple[str, ...] | None = None

    def __init__(self, order: list[str]):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("held", self.held)

    def step(self, state: tuple, row: Row):
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state, last = self.state.get() if self.state.exists() else self.start, 0
        for row in in_order(rows, self.order, self.reads):
            state, values = self.step(state, row)
            last = max(last, row["at"] or 0)
            if values is not None:
                yield self.made(*values)
        self.state.update(state)
        self.forget_after(last, timerValues)

    def forget_after(self, last: int, timers) -> None:
        """Sets the key's only timer."""
        if self.span_us is not None and timers.getCurrentWatermarkInMs() >= 0:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(last // 1000, timers.getCurrentWatermarkInMs()) + self.span_us // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.clear()
        return iter([])

    def clear(self) -> None:
        self.state.clear()

    def made(self, *values) -> Row:
        return Row(*[f.strip().split()[0] for f in self.out.split(",")])(*values)

    def close(self) -> None:
        pass


class Terminals(Machine):
    """Rows that bring a task to another terminal status than its last one; other statuses are passed over."""

    reads = ("at", "url", "event_id", "status")
    held, start, out = "status string", (None,), "url string, event_id long, status string"

    def __init__(self, order: list[str], terminal: tuple[str, ...] = TERMINAL):
        super().__init__(order)
        self.terminal = terminal

    def step(self, state, row):
        if row["status"] not in self.terminal or row["status"] == state[0]:
            return state, None
        return (row["status"],), (row["url"], row["event_id"], row["status"])


class Writes(Machine):
    """Rows whose version is above all that came before; older and equal ones are turned away."""

    reads = ("at", "url", "event_id", "version")
    held, start, out = "version long", (None,), "url string, event_id long, version long"

    def step(self, state, row):
        v = row["version"]
        if v is None or (state[0] is not None and v <= state[0]):
            return state, None
        return (v,), (row["url"], row["event_id"], v)


class Skips(Machine):
    """Rows whose `streak` rows just before failed, all of them."""

    reads = ("at", "url", "event_id", "status")
    held, start, out = "streak int", (0,), "url string, event_id long"

    def __init__(self, order: list[str], streak: int = 3, good: str = "ok"):
        super().__init__(order)
        self.streak, self.good = streak, good

    def step(self, state, row):
        n = 0 if row["status"] == self.good else min(state[0] + 1, self.streak)
        return (n,), (row["url"], row["event_id"]) if state[0] >= self.streak else None


class Fresh(Machine):
    """Each row with whether its key's entry before is at most `ttl_us` old; the entry goes after that time."""

    reads = ("at", "url", "event_id")
    held, start, out = "at long", (None,), "url string, event_id long, fresh boolean"

    def __init__(self, order: list[str], ttl_us: int = 20_000_000):
        super().__init__(order)
        self.ttl_us = self.span_us = ttl_us

    def step(self, state, row):
        return (row["at"],), (row["url"], row["event_id"], state[0] is not None and row["at"] - state[0] <= self.ttl_us)


class Cooling(Machine):
    """Each row with whether its domain's last failure is less than `cool_us` old."""

    reads = ("at", "domain", "event_id", "result")
    held, start, out = "failed_at long", (None,), "domain string, event_id long, cooling boolean"

    def __init__(self, order: list[str], cool_us: int = 300_000_000):
        super().__init__(order)
        self.cool_us = self.span_us = cool_us

    def step(self, state, row):
        cooling = state[0] is not None and row["at"] - state[0] < self.cool_us
        return (row["at"],) if row["result"] == "failed" else state, (row["domain"], row["event_id"], cooling)


class Tiers(Machine):
    """Each change of a domain's speed tier: down after `fails` failures running, up (to `top` at most) after `oks`
    successes running and `cool_us` since the last failure."""

    reads = ("at", "domain", "event_id", "result")
    held, out = "tier int, bad int, good int, failed_at long", "domain string, event_id long, at long, tier int, moved string"
    span_us = 7 * 86_400_000_000

    def __init__(self, order: list[str], top: int = 3, fails: int = 3, oks: int = 30, cool_us: int = 180_000_000):
        super().__init__(order)
        self.top, self.fails, self.oks, self.cool_us = top, fails, oks, cool_us
        self.start = (top, 0, 0, 0)

    def step(self, state, row):
        tier, bad, good, failed = state
        moved = None
        if row["result"] == "failed":
            bad, good, failed = bad + 1, 0, row["at"]
            if bad >= self.fails and tier > 0:
                tier, bad, moved = tier - 1, 0, "down"
        else:
            bad, good = 0, good + 1
            if good >= self.oks and tier < self.top and row["at"] - failed >= self.cool_us:
                tier, good, moved = tier + 1, 0, "up"
        return (tier, bad, good, failed), (row["domain"], row["event_id"], row["at"], tier, moved) if moved else None


class Breaker(Machine):
    """When a domain's breaker opens or is extended: after `fails` failures running, for `open_us` from the last
    request inside the open window; a success outside the window resets the count."""

    reads = ("at", "domain", "event_id", "result")
    held, start, out = "bad int, closes long", (0, 0), "domain string, event_id long, opened long, closes long"
    span_us = 7 * 86_400_000_000

    def __init__(self, order: list[str], fails: int = 5, open_us: int = 600_000_000):
        super().__init__(order)
        self.fails, self.open_us = fails, open_us

    def step(self, state, row):
        bad, closes = state
        at, opens = row["at"], False
        if at < closes:
            opens = True
        elif row["result"] == "failed":
            bad += 1
            if bad >= self.fails:
                bad, opens = 0, True
        else:
            bad = 0
        if opens:
            closes = at + self.open_us
        return (bad, closes), (row["domain"], row["event_id"], at, closes) if opens else None


class Ring(Machine):
    """After each trigger the last `size` rows of a key, with `cursor`, a row's number since the start, and `upto`, the key's
    number of rows: the ring as it stands has the greatest `upto` (see `latest`)."""

    reads = ("at", "event_id")
    held, start, out = "total long", (0,), "url string, event_id long, cursor long, upto long"

    def __init__(self, order: list[str], size: int = 500):
        super().__init__(order)
        self.size = size

    def init(self, handle):
        super().init(handle)
        self.rows = handle.getListState("rows", "event_id long")

    def kept(self, old: list[tuple], row: Row) -> list[tuple]:
        return [*old, (row["event_id"],)]

    def handleInputRows(self, key, rows, timerValues):
        total, last = (self.state.get() if self.state.exists() else self.start)[0], 0
        ring = list(self.rows.get()) if self.rows.exists() else []
        for row in in_order(rows, self.order, self.reads):
            before, ring = len(ring), self.kept(ring, row)
            total += len(ring) - before
            ring, last = ring[-self.size :], max(last, row["at"] or 0)
        self.rows.put(ring)
        self.state.update((total,))
        self.forget_after(last, timerValues)
        for k, entry in enumerate(ring):
            yield self.made(key[0], *entry, total - len(ring) + k + 1, total)

    def clear(self):
        super().clear()
        self.rows.clear()


class Notices(Ring):
    """A bounded queue of notices: the oldest goes when it is full, and a notice that repeats the one before takes its place."""

    reads = ("at", "event_id", "url", "status")
    out = "domain string, event_id long, url string, status string, cursor long, upto long"

    def __init__(self, order: list[str], size: int = 5):
        super().__init__(order, size)

    def init(self, handle):
        Machine.init(self, handle)
        self.rows = handle.getListState("rows", "event_id long, url string, status string")

    def kept(self, old, row):
        new = (row["event_id"], row["url"], row["status"])
        return [*old[:-1], new] if old and tuple(old[-1][1:]) == new[1:] else [*old, new]


class Tasks(Machine):
    """The task of each row: a request for a URL of the domain whose task has not ended gets that task, any other begins one,
    named by its row."""

    reads = ("at", "url", "event_id", "status")
    out = "url string, event_id long, task long"

    def __init__(self, order: list[str], terminal: tuple[str, ...] = TERMINAL):
        super().__init__(order)
        self.terminal = terminal

    def init(self, handle):
        super().init(handle)
        self.tasks = handle.getMapState("tasks", "url string", "task long")

    def handleInputRows(self, key, rows, timerValues):
        last = 0
        for row in in_order(rows, self.order, self.reads):
            url, last = (row["url"],), max(last, row["at"] or 0)
            task = self.tasks.getValue(url)[0] if self.tasks.containsKey(url) else row["event_id"]
            if row["status"] not in self.terminal:
                self.tasks.updateValue(url, (task,))
            elif self.tasks.containsKey(url):
                self.tasks.removeKey(url)
            yield self.made(row["url"], row["event_id"], task)
        self.forget_after(last, timerValues)

    def clear(self):
        self.tasks.clear()


def run(log: DataFrame, key: str, machine: Machine, late: str | None = None, ts: str = "ts") -> DataFrame:
    """The rows that `machine` makes of a log, streaming or not."""
    with_state_store(log.sparkSession)
    log = timed(log.withColumn(ts, F.col(ts).cast("timestamp")), ts)
    if late is not None:
        log = log.withWatermark(ts, late)
    if machine.reads is not None:
        log = log.select(*dict.fromkeys([key, *machine.order, *machine.reads, *([ts] if late is not None else [])]))
    return log.groupBy(key).transformWithState(machine, machine.out, "Append", "EventTime" if late is not None else "None")


def latest(rings: DataFrame, key: str) -> DataFrame:
    """The rings as they stand, of all that `Ring` or `Notices` gave."""
    newest = rings.groupBy(key).agg(F.max("upto").alias("__upto"))
    return rings.join(newest, key).where("upto = __upto").drop("__upto", "upto").distinct()


def two_step(signs: DataFrame, contents: DataFrame, key: str, within: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Responses of a request in two steps, landed as two tables: each content with the sign responses of its key that came at
    most `within` before it. Both have (key, ts) and other columns of their own; `late` bounds what either side keeps."""
    a = signs.withWatermark("ts", late).select(F.col(key).alias("__key"), F.col("ts").alias("signed"), *[c for c in signs.columns if c not in (key, "ts")])
    b = contents.withWatermark("ts", late)
    return b.join(a, (F.col(key) == F.col("__key")) & (F.col("signed") <= F.col("ts")) & (F.col("ts") <= F.expr(f"signed + interval {within}"))).drop("__key")
