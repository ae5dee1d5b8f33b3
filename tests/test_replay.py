import datetime
import random

import pytest
from pyspark.sql import functions as F

from lexforge.operators import ledger, replay

D, T = datetime.date, datetime.datetime


def brute(users, events, plans):
    out = []
    for u, role, plan, ends, quota, set_on in users:
        staff = role in ledger.STAFF
        for e, _, at, kind, code, months in sorted((x for x in events if x[1] == u), key=lambda x: (x[2], x[0])):
            day = at.date()
            if plan != "gratuit" and ends is not None and ends < day:
                plan, ends, quota, set_on = "gratuit", None, plans["gratuit"], day
            elif set_on is None or (set_on.year, set_on.month) < (day.year, day.month):
                quota, set_on = plans.get(plan, plans["gratuit"]), day
            allowed, cost = None, 0
            if kind == "plan":
                plan, ends, quota, set_on = code, day + datetime.timedelta(days=30 * (months or 1)), plans.get(code, plans["gratuit"]) * (months or 1), day
            else:
                allowed = staff or quota > 0
                if allowed and kind == "answered" and not staff:
                    cost, quota = 1, quota - 1
            out.append((e, u, plan, allowed, cost, quota))
    return sorted(out)


@pytest.mark.parametrize("seconds", [3600, 86400 * 20, 10**9])
def test_replay_against_a_loop(spark, monkeypatch, seconds):
    monkeypatch.setattr(replay, "BLOCK_SECONDS", seconds)
    r = random.Random(seconds)
    users = [(i, r.choice(["utilisateur", "utilisateur", "admin"]), r.choice(["gratuit", "essentiel", "cabinet", "nope"]), r.choice([None, D(2024, 1, 20), D(2024, 3, 2)]), r.randint(0, 8), r.choice([None, D(2023, 12, 5), D(2024, 1, 5), D(2024, 9, 1)])) for i in range(12)]
    events = []
    for e in range(900):
        at = T(2024, 1, 1) + datetime.timedelta(minutes=r.randint(0, 60 * 24 * 150) // r.choice([1, 1, 30]))
        kind = r.choice(["answered"] * 8 + ["unanswered", "plan"] if e % 5 == 0 else ["answered"] * 8 + ["unanswered"])
        code = r.choice(["essentiel", "essai", "nope"]) if kind == "plan" else None
        events.append((e, r.choice([0, 0, 0, *range(14)]), at, kind, code, r.choice([None, 1, 2]) if code else None))
    plans = {code: credits for code, _, credits, *_ in ledger.PLANS}
    got = replay.replayed_quotas(
        spark.createDataFrame(users, "user_id int, role string, plan string, plan_ends date, quota int, quota_set_on date"),
        spark.createDataFrame(events, "event_id int, user_id int, at timestamp, kind string, code string, months int"), ledger.plans(spark),
    )
    assert sorted(tuple(x) for x in got.collect()) == brute(users, events, plans)
    assert got.where("quota = 0").count() > 10 and got.where("NOT allowed").count() > 10


def test_no_events(spark):
    users = spark.createDataFrame([(1, "admin", "gratuit", None, 1, None)], "user_id int, role string, plan string, plan_ends date, quota int, quota_set_on date")
    events = spark.createDataFrame([(1, 2, T(2024, 1, 1), "answered", None, None)], "event_id int, user_id int, at timestamp, kind string, code string, months int")
    assert replay.replayed_quotas(users, events, ledger.plans(spark)).count() == 0
    assert replay.replayed_quotas(users, events.where(F.lit(False)), ledger.plans(spark)).count() == 0
