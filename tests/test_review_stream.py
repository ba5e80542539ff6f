"""Keyed review states: equal to one aggregation, expired by timers, going on after a restart."""

import datetime
import itertools
import random
from types import SimpleNamespace

import pandas as pd
import pytest

from attestry.streaming import review

SHAPE = "claim_id long, kind string, at timestamp, verdict string, t1 long, t2 long, t3 long"


def day(n):
    return datetime.datetime(2026, 1, 1) + datetime.timedelta(days=n)


def claim(k, n):
    return (k, "claim", day(n), None, 0, 0, 0)


def check(k, n, verdict, t1=1):
    return (k, "check", day(n), verdict, t1, 0, 0)


@pytest.fixture
def stage(spark, tmp_path):
    """Adds a file of events and runs the stream over what is new."""
    folder, numbers = f"file://{tmp_path}/in", itertools.count()

    def add(rows):
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.mode("append").parquet(f"{folder}/part={next(numbers)}")
        stream = spark.readStream.schema(SHAPE).parquet(folder)
        found = review.run(stream.select(*(c.split()[0] for c in SHAPE.split(", "))), f"file://{tmp_path}/out")
        return found.orderBy("claim_id", "number").collect()

    return add


def test_a_restart_goes_on_and_timers_expire(stage):
    first = stage([claim(1, 0), check(1, 5, "NEUTRAL"), claim(2, 0), claim(3, 1), check(4, 2, "ENTAILED")])
    assert [(r["claim_id"], r["number"], r["status"]) for r in first] == [(1, 1, "PENDING_REVIEW"), (2, 1, "PENDING_VERIFICATION"), (3, 1, "PENDING_VERIFICATION")]
    second = stage([check(1, 20, "ENTAILED"), check(1, 4, "CONTRADICTED"), check(3, 10, "ENTAILED"), claim(4, 1)])
    assert [(r["claim_id"], r["number"], r["status"]) for r in second if r["number"] > 1 or r["claim_id"] == 4] == [(1, 2, "AUTO_APPROVED"), (3, 2, "AUTO_APPROVED"), (4, 1, "AUTO_APPROVED")]
    third = stage([claim(9, 125)])  # the watermark passes day 90
    assert [(r["claim_id"], r["status"]) for r in third if r["number"] == 2] == [(1, "AUTO_APPROVED"), (2, "EXPIRED"), (3, "AUTO_APPROVED")]
    assert len(third) == len({(r["claim_id"], r["number"]) for r in third})


def test_states_equal_one_aggregation(spark, stage):
    chance = random.Random(3)
    rows = []
    for k in range(120):
        rows += [claim(k, chance.randint(0, 40))] * (chance.random() < 0.95)
        rows += [check(k, chance.randint(0, 160), chance.choice(("ENTAILED", "NEUTRAL", "CONTRADICTED")), t) for t in range(chance.choice((0, 0, 1, 1, 2, 4)))]
    chance.shuffle(rows)
    found = stage(rows)
    last = {r["claim_id"]: r["status"] for r in found}  # in order of number
    expected = {r["claim_id"]: r["status"] for r in review.folded(spark.createDataFrame(rows, SHAPE), str(max(r[2] for r in rows) - datetime.timedelta(days=30))).collect()}
    assert last == expected and set(last.values()) == {"PENDING_REVIEW", "AUTO_APPROVED", "EXPIRED"} | ({"PENDING_VERIFICATION"} & set(expected.values()))


def test_state_is_let_go(spark, stage):
    stage([claim(1, 0), check(1, 3, "NEUTRAL")])
    stage([claim(2, 300)])  # the watermark passes day 200
    found = stage([check(2, 301, "ENTAILED")])
    assert [(r["claim_id"], r["status"]) for r in found] == [(1, "PENDING_REVIEW"), (2, "PENDING_VERIFICATION"), (2, "AUTO_APPROVED")]


class Held:
    """A state and its timers, counted."""

    def __init__(self):
        self.value, self.timers, self.writes = None, set(), 0
        self.registerTimer, self.deleteTimer, self.listTimers = self.timers.add, self.timers.discard, lambda: iter(self.timers)

    def getValueState(self, name, shape):  # noqa: N802
        return self

    def get(self):
        return self.value

    def update(self, value):
        self.value, self.writes = value, self.writes + 1

    def clear(self):
        self.value = None


def test_neighbouring_claims_share_one_state_and_one_timer():
    """A thousand claims are one write; each is expired at its own time, one timer after the other, until all are let go."""
    us = lambda n: n * 86_400_000_000
    rows = pd.DataFrame([(k, "claim", us(k % 40), None, 0, 0, 0) for k in range(1000)] + [(k, "check", us(50), "ENTAILED", 1, 0, 0) for k in range(500)], columns=["claim_id", "kind", "us", "verdict", "t1", "t2", "t3"])
    held, machine = Held(), review.Review()
    machine.init(held)
    first = pd.concat(machine.handleInputRows((0,), iter([rows]), None))
    assert (held.writes, len(held.timers)) == (1, 1) and first["status"].value_counts().to_dict() == {"AUTO_APPROVED": 500, "PENDING_VERIFICATION": 500}
    expired, fired = [], 0
    while held.timers:
        timer, fired = min(held.timers), fired + 1
        time = SimpleNamespace(getCurrentWatermarkInMs=lambda: timer + 1, getExpiryTimeInMs=lambda: timer)  # noqa: B023
        expired += list(machine.handleExpiredTimer((0,), time, time))
        held.timers.discard(timer)
    found = pd.concat(expired)
    assert sorted(found["claim_id"]) == list(range(500, 1000)) and (found["at"] == us(found["claim_id"] % 40 + 90)).all() and set(found["number"]) == {2}
    assert held.value is None and fired <= 80
