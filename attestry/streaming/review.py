"""Claims that wait for their verification, as keyed state with timers.

A claim waits from its creation on.  Verifications may come in any order, before the claim too:
the one that is latest by (time, t1, t2, t3) counts, and entailment approves while anything
else sends the claim to review.  A claim whose first verification comes later than ``WAIT_DAYS``
has expired; one without any is expired by a timer of event time when the watermark passes that
day.  ``KEEP_DAYS`` after its creation a claim's state is let go, by a timer too, so the
state holds open claims only; what comes later than that is late and not seen.  Neighbouring
claims share a state and its timer, which is set to the one that is due first.

A row is given whenever a claim's status changes; its number counts the changes of the claim.
State lies in RocksDB and in the checkpoint, so a query that is started again goes on.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WAIT_DAYS, KEEP_DAYS, LATE = 90, 200, "30 days"
CHANGES = "claim_id long, number int, status string, at timestamp"
#: So many neighbouring claim numbers share a state; times in it are microseconds.
SPAN, DAY = 1024, 86_400_000_000
_HELD = "claim_id array<long>, created array<long>, first array<long>, last array<long>, t1 array<long>, t2 array<long>, t3 array<long>, verdict array<string>, status array<string>, number array<int>"
FIELDS = ("created", "first", "last", "t1", "t2", "t3", "verdict", "status", "number")
_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def status_of(created, first, verdict, expired: bool = False) -> str | None:
    """The status of a claim, by times in microseconds; None before it is created."""
    if created is None:
        return None
    if first is None:
        return "EXPIRED" if expired else "PENDING_VERIFICATION"
    if first > created + WAIT_DAYS * DAY:
        return "EXPIRED"
    return "AUTO_APPROVED" if verdict == "ENTAILED" else "PENDING_REVIEW"


class Review(StatefulProcessor):
    """Claims of ``SPAN`` neighbouring numbers go by one key, so a state is read and written once for all of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def _load(self) -> dict[int, dict]:
        held = self.held.get()
        return {} if held is None else {k: dict(zip(FIELDS, values, strict=True)) for k, *values in zip(*held, strict=True)}

    def _keep(self, claims: dict[int, dict], fired: int | None = None) -> None:
        """Stores the claims; the next timer is that of the claim that is due first."""
        if not claims:
            self.held.clear()
            return
        self.held.update((list(claims), *([now[f] for now in claims.values()] for f in FIELDS)))
        due = [self._due(now) for now in claims.values() if now["created"] is not None]
        waiting = [timer for timer in self.handle.listTimers() if timer != fired]
        if due and (not waiting or min(due) // 1000 < min(waiting)):
            for timer in waiting:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(min(due) // 1000)

    @staticmethod
    def _due(now: dict) -> int:
        return now["created"] + (KEEP_DAYS if now["first"] is not None or now["status"] == "EXPIRED" else WAIT_DAYS) * DAY

    @staticmethod
    def _moved(now: dict, expired: bool = False) -> bool:
        status = status_of(now["created"], now["first"], now["verdict"], expired or now["status"] == "EXPIRED" and now["first"] is None)
        moved = status is not None and status != now["status"]
        if moved:
            now |= {"status": status, "number": now["number"] + 1}
        return moved

    @staticmethod
    def _rows(moved: list[tuple]):
        if moved:
            yield pd.DataFrame(moved, columns=["claim_id", "number", "status", "at"]).astype({"number": "int32"})

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        claims, seen = self._load(), {}
        for frame in rows:
            for k, kind, at, verdict, *ties in zip(*(frame[c].tolist() for c in ("claim_id", "kind", "us", "verdict", "t1", "t2", "t3")), strict=True):
                now = claims.setdefault(k, dict.fromkeys(FIELDS) | {"number": 0})
                seen[k] = max(at, seen.get(k, at))
                if kind == "claim":
                    now["created"] = at if now["created"] is None else min(now["created"], at)
                    continue
                now["first"] = at if now["first"] is None else min(now["first"], at)
                if now["last"] is None or (at, *ties) > (now["last"], now["t1"], now["t2"], now["t3"]):
                    now |= dict(zip(("last", "t1", "t2", "t3", "verdict"), (at, *ties, verdict), strict=True))
        moved = [(k, claims[k]["number"], claims[k]["status"], at) for k, at in seen.items() if self._moved(claims[k])]
        self._keep(claims)
        yield from self._rows(moved)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        until = 1000 * max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs() + 1)
        claims, moved = self._load(), []
        for k, now in claims.items():
            if now["created"] is not None and now["first"] is None and self._due(now) < until and self._moved(now, expired=True):
                moved.append((k, now["number"], now["status"], now["created"] + WAIT_DAYS * DAY))
        self._keep({k: now for k, now in claims.items() if now["created"] is None or now["created"] + KEEP_DAYS * DAY >= until}, expiredTimerInfo.getExpiryTimeInMs())
        yield from self._rows(moved)

    def close(self) -> None:
        """Spark closes the state."""


def changes(events: DataFrame) -> DataFrame:
    """Changes of status of a stream of (claim_id, kind, at, verdict, t1, t2, t3); kind is claim or check."""
    timed = events.where("claim_id is not null and at is not null").withWatermark("at", LATE)
    rows = timed.select("*", F.floor(F.col("claim_id") / SPAN).alias("span"), F.unix_micros(F.col("at").cast("timestamp")).alias("us"))
    found = rows.groupBy("span").transformWithStateInPandas(statefulProcessor=Review(), outputStructType="claim_id long, number int, status string, at long", outputMode="Append", timeMode="EventTime")
    return found.withColumn("at", F.timestamp_micros("at"))


def run(events: DataFrame, path: str) -> DataFrame:
    """All changes so far, after running over what is there; started again it goes on from its checkpoint."""
    spark = events.sparkSession
    before = spark.conf.get(_STORE[0])
    spark.conf.set(*_STORE)
    try:
        changes(events).writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start(f"{path}/rows").awaitTermination()
    finally:
        spark.conf.set(_STORE[0], before)
    return spark.read.schema(CHANGES).parquet(f"{path}/rows")


def last_status(found: DataFrame) -> DataFrame:
    return found.groupBy("claim_id").agg(F.max_by("status", "number").alias("status"))


def folded(events: DataFrame, until: str) -> DataFrame:
    """The same from a table of all events, as one aggregation; ``until`` is the day that time has come to."""
    check = F.col("kind") == "check"
    g = events.groupBy("claim_id").agg(
        F.min(F.when(~check, F.col("at"))).alias("created"), F.min(F.when(check, F.col("at"))).alias("first"), F.max(F.when(check, F.struct("at", "t1", "t2", "t3", "verdict"))).alias("x"),
    ).where("created is not null")
    end = F.col("created") + F.expr(f"interval {WAIT_DAYS} days")
    status = (
        F.when(F.col("first").isNull(), F.when(end < F.lit(until).cast("timestamp"), "EXPIRED").otherwise("PENDING_VERIFICATION")).when(F.col("first") > end, "EXPIRED")
        .when(F.col("x.verdict") == "ENTAILED", "AUTO_APPROVED").otherwise("PENDING_REVIEW")
    )
    return g.select("claim_id", status.alias("status"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims and their verifications as one stream."""
    from .logs import table_stream

    none = F.lit(None)
    orders = table_stream(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("claim_id"), F.lit("claim").alias("kind"), F.col("o_orderdate").cast("timestamp").alias("at"), none.cast("string").alias("verdict"), *(F.lit(0).cast("long").alias(t) for t in ("t1", "t2", "t3")))
    verdict = F.when(F.col("l_returnflag") == "A", "ENTAILED").when(F.col("l_returnflag") == "N", "NEUTRAL").when(F.col("l_partkey") % 23 == 0, "VERIFIER_ERROR").otherwise("CONTRADICTED")
    lines = table_stream(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("long").alias("claim_id"), F.lit("check").alias("kind"), F.col("l_shipdate").cast("timestamp").alias("at"), verdict.alias("verdict"),
        F.col("l_linenumber").cast("long").alias("t1"), F.col("l_partkey").cast("long").alias("t2"), F.col("l_suppkey").cast("long").alias("t3"),
    )
    return orders.unionByName(lines)


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last status of every claim."""
    from ..storage import scratch

    return last_status(run(event_stream(spark, sf_dir), scratch(spark, "review")))
