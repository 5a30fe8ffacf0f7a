"""A status machine over a log of wishes, for batches and streams, with recovery from crashes.

A ``Machine`` is a table: which wish a status grants, and where it leads.  A wish that a status
does not grant is refused and changes nothing.  Every log entry of a job is a sign of life; a job
that is active without one for longer than ``timeout`` has crashed: its time counts up to the last
sign only, and it goes where ``recovery`` says.  Crashes show at the next entry, or at the end of
time (``as_of``; a stream's watermark), which timers watch.

* ``follow`` keeps one state a job (``transformWithState``): a stream goes on from its checkpoint
  after a stop, and late entries count from the last one without going back in time.
* ``replay`` gives the same table from a whole log.  An entry maps every status to its next one,
  and such maps can be joined in any grouping: ranges of the log are folded for all statuses they
  could begin in (where a job begins, for the initial one), then a job's ranges are chained, so that a
  job with all entries is spread over tasks.

Edge cases: an empty log has no jobs; a null or unknown wish is refused by every status; a null job
is a job; entries of one time go by ``id``; repeated entries are entries; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from quaver.operators.ranges import PART, ROWS, carried, ranged


@dataclass(frozen=True)
class Machine:
    """``rules``: (status, wish) -> next status.  ``recovery``: where a crash leads, for the active statuses, whose time counts."""

    initial: str
    rules: Mapping[tuple[str, str], str]
    recovery: Mapping[str, str]
    timeout: int  # microseconds

    @property
    def statuses(self) -> list[str]:
        return sorted({self.initial, *(s for s, _ in self.rules), *self.rules.values(), *self.recovery, *self.recovery.values()})

    @property
    def wishes(self) -> list[str]:
        return sorted({w for _, w in self.rules})

    def alive(self, s: dict, at: int) -> dict:
        """The state when time reaches ``at``: an active job without a sign for too long has crashed."""
        if s["status"] not in self.recovery:
            return s
        gap = max(0, at - s["updated"])
        if gap > self.timeout:
            return {**s, "status": self.recovery[s["status"]], "crashes": s["crashes"] + 1}
        return {**s, "elapsed": s["elapsed"] + gap}

    def step(self, s: dict | None, at: int, wish: str | None) -> dict:
        s = {"status": self.initial, "elapsed": 0, "starts": 0, "refused": 0, "crashes": 0, "updated": at} if s is None else self.alive(s, at)
        to = self.rules.get((s["status"], wish))
        begins = to in self.recovery and s["status"] not in self.recovery
        return {**s, "status": to or s["status"], "starts": s["starts"] + begins, "refused": s["refused"] + (to is None), "updated": max(at, s["updated"])}


#: A song's statuses; "stopping" is running with a cancel asked for.
SONGS = Machine(
    "queued",
    {
        ("queued", "claim"): "running", ("queued", "cancel"): "cancelled",
        ("running", "progress"): "running", ("running", "pause"): "waiting", ("running", "complete"): "completed", ("running", "fail"): "failed", ("running", "cancel"): "stopping",
        ("stopping", "progress"): "stopping", ("stopping", "pause"): "cancelled", ("stopping", "complete"): "completed", ("stopping", "fail"): "cancelled",
        ("waiting", "resolve"): "queued", ("waiting", "cancel"): "cancelled",
        ("completed", "retry"): "queued", ("failed", "retry"): "queued", ("cancelled", "retry"): "queued",
    },
    {"running": "queued", "stopping": "cancelled"},
    12 * 3600 * 1_000_000,
)
FIGURES = ("elapsed", "starts", "refused", "crashes")


def _fold(entries: Column, before: Column, m: Machine) -> Column:
    """struct(last, arms): what a run of entries makes of each status it could begin in; with none ``before`` it, of the initial one only."""
    names = m.statuses
    code = {s: i for i, s in enumerate(names)}
    ints = lambda xs: F.array(*[F.lit(x) for x in xs])
    to = F.array(*[ints(code.get(m.rules.get((s, w)), -1) for s in names) for w in m.wishes], ints([-1] * len(names)))
    active, recovered = ints(int(s in m.recovery) for s in names), ints(code[m.recovery.get(s, s)] for s in names)
    zero = F.lit(0).cast("long")
    arms = F.array(*[F.struct(F.lit(i).alias("status"), *[zero.alias(f) for f in FIGURES]) for i in range(len(names))])
    begin = F.when(before.isNull(), F.slice(arms, code[m.initial] + 1, 1)).otherwise(arms)

    def one(arm: Column, gap: Column, w: Column) -> Column:
        on, crash = F.get(active, arm["status"]), gap > m.timeout
        now = F.when(crash, F.get(recovered, arm["status"])).otherwise(arm["status"])
        goal = F.get(F.get(to, w), now)
        after = F.when(goal < 0, now).otherwise(goal)
        return F.struct(
            after.alias("status"), (arm["elapsed"] + F.when(crash, 0).otherwise(gap * on)).alias("elapsed"),
            (arm["starts"] + F.get(active, after) * (1 - F.get(active, now))).alias("starts"),
            (arm["refused"] + (goal < 0).cast("int")).alias("refused"), (arm["crashes"] + on * crash.cast("int")).alias("crashes"),
        )

    def step(acc: Column, e: Column) -> Column:
        gap = F.greatest(zero, F.coalesce(e["at"] - acc["last"], zero))
        return F.struct(F.greatest(e["at"], acc["last"]).alias("last"), F.transform(acc["arms"], lambda arm: one(arm, gap, e["w"])).alias("arms"))

    return F.aggregate(entries, F.struct(before["at"].alias("last"), begin.alias("arms")), step)


def replay(log: DataFrame, machine: Machine = SONGS, *, job: str = "job", at: str = "at", id: str = "id", wish: str = "wish", rows: int = ROWS) -> DataFrame:
    """(job, status, elapsed, starts, refused, crashes, updated) of a whole log; ``at`` and times in microseconds, as of the log's last entry."""
    names = machine.statuses
    known = F.coalesce(F.array_position(F.array(*[F.lit(w) for w in machine.wishes]), F.col(wish)), F.lit(0))
    code = F.when(known == 0, len(machine.wishes)).otherwise(known - 1).cast("int")
    cut = ranged(log.select(F.col(job).alias("job"), F.col(at).cast("long").alias("at"), F.col(id).alias("id"), code.alias("w")), ["job"], ["at", "id"], rows)
    # folding is work in itself, however few bytes it reads: as many tasks as ranges
    ranges = (cut.agg(F.max(PART)).first()[0] or 0) + 1
    parts = cut.repartition(ranges, PART).groupBy(PART, "job").agg(F.array_sort(F.collect_list(F.struct("at", "id", "w"))).alias("entries"))
    before = carried(cut, ["job"], ["at", "id"], F.struct("at"))  # null where a job begins
    both = parts.join(F.broadcast(before), (parts[PART] == before[PART]) & parts["job"].eqNullSafe(before["job"]), "left")
    folded = both.select(parts[PART], parts["job"], _fold(parts["entries"], before["carried"], machine).alias("f"))
    chain = folded.groupBy("job").agg(F.array_sort(F.collect_list(F.struct(PART, "f"))).alias("parts"), F.max("f.last").alias("updated"))
    zero = F.lit(0).cast("long")
    first = F.struct(F.lit(names.index(machine.initial)).alias("status"), *[zero.alias(f) for f in FIGURES])

    def join(acc: Column, p: Column) -> Column:
        arms = p["f"]["arms"]
        arm = F.get(arms, F.when(F.size(arms) == 1, 0).otherwise(acc["status"]))
        return F.struct(arm["status"].alias("status"), *[(acc[f] + arm[f]).alias(f) for f in FIGURES])

    # the end of time is one row
    done = chain.withColumn("s", F.aggregate("parts", first, join)).crossJoin(F.broadcast(cut.agg(F.max("at").alias("as_of"))))
    status = F.get(F.array(*[F.lit(s) for s in names]), F.col("s.status"))
    goes = F.get(F.array(*[F.lit(machine.recovery.get(s)) for s in names]), F.col("s.status"))
    lost = goes.isNotNull() & (F.col("as_of") - F.col("updated") > machine.timeout)
    return done.select("job", F.when(lost, goes).otherwise(status).alias("status"), *[F.col(f"s.{f}").alias(f) for f in FIGURES[:-1]], (F.col("s.crashes") + lost.cast("int")).alias("crashes"), "updated")


_STATE = StructType([StructField("status", StringType()), *(StructField(f, LongType()) for f in (*FIGURES, "updated", "seq"))])


class _Follower(StatefulProcessor):
    """A job's state; a timer stands where an active job without a further entry counts as crashed."""

    def __init__(self, machine: Machine) -> None:
        self.machine = machine

    def init(self, handle) -> None:
        self.handle, self.state = handle, handle.getValueState("job", _STATE)

    def _load(self) -> tuple[dict | None, int]:
        if not self.state.exists():
            return None, 0
        s = dict(zip(_STATE.names, self.state.get(), strict=True))
        return s, s.pop("seq")

    def _keep(self, key: tuple, s: dict, seq: int) -> Iterator[Row]:
        now = {n: {**s, "seq": seq}[n] for n in _STATE.names}
        self.state.update(tuple(now.values()))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if s["status"] in self.machine.recovery:
            self.handle.registerTimer((s["updated"] + self.machine.timeout) // 1000)
        yield Row(job=key[0], **now)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s, seq = self._load()
        for at, _, wish in sorted(((r["at"], r["id"], r["wish"]) for r in rows), key=lambda x: x[:2]):
            s, seq = self.machine.step(s, at, wish), seq + 1
        yield from self._keep(key, s, seq)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s, seq = self._load()
        now = timerValues.getCurrentWatermarkInMs() * 1000
        if s and now - s["updated"] > self.machine.timeout:
            yield from self._keep(key, self.machine.alive(s, now), seq + 1)

    def close(self) -> None:
        pass


def follow(log: DataFrame, machine: Machine = SONGS, *, job: str = "job", at: str = "at", id: str = "id", wish: str = "wish", late: str = "0 seconds") -> DataFrame:
    """A job's row (as ``replay``, and ``seq``, which rises) whenever it changes, on a stream; the state store must be RocksDB's."""
    rows = log.select(F.col(job).alias("job"), F.col(at).cast("long").alias("at"), F.col(id).alias("id"), F.col(wish).alias("wish"), F.timestamp_micros(F.col(at).cast("long")).alias("time"))
    shape = StructType([StructField("job", rows.schema["job"].dataType), *_STATE.fields])
    return rows.withWatermark("time", late).groupBy("job").transformWithState(_Follower(machine), shape, "Update", "EventTime")
