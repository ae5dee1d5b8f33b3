"""The quota of every user after every event, replayed from the table of events.

An event changes a quota by setting it (a plan begins, a plan has ended, a month has begun) or by taking one off, never
below zero. Such functions compose: what follows a setting does not depend on what was before it, and n decrements in a
row leave max(q - n, 0). So the last setting up to an event and the number of charges since then give the quota, and both
are running values that `scans` reads block by block: one user's events are many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scans
from .ledger import FREE, MONTH_DAYS, is_staff

#: Seconds of a user's events that are read together.
BLOCK_SECONDS = 6 * 3600


def _left(quota: Column, charges: Column) -> Column:
    """What a number of charges leave of a quota; one that is used up stays as it is."""
    return F.when(quota > 0, F.greatest(quota - charges, F.lit(0))).otherwise(quota)


def replayed_quotas(users: DataFrame, events: DataFrame, catalogue: DataFrame) -> DataFrame:
    """event_id, user_id, plan, allowed, cost and quota after each of events(event_id, user_id, at, kind, code, months), in the
    order of at and then event_id, beginning with users(user_id, role, plan, plan_ends, quota, quota_set_on).

    kind: "answered" and "unanswered" questions, which staff may always ask and others while they have a quota, and which cost
    one if they are answered; "plan": code begins, for some months. Every event is an access: a plan that has ended becomes
    the free one with its credits, else a new month brings the plan's credits. An unknown plan has the free one's. Events of
    unknown users are none."""
    free = catalogue.where(F.col("code") == FREE).agg(F.max("credits").alias("free_credits"))  # one row
    credits_of = catalogue.select("code", "credits")
    own = users.join(credits_of.withColumnRenamed("code", "plan"), "plan", "left").select(
        "user_id", is_staff(F.col("role")).alias("staff"), F.struct(F.col("plan"), F.col("plan_ends").alias("ends"), "credits").alias("first_plan"),
        F.col("quota").cast("long").alias("first_quota"), F.col("quota_set_on").alias("first_set_on"),
    )
    begun = F.when(F.col("kind") == "plan", F.struct(F.col("code").alias("plan"), F.date_add("day", (F.coalesce("months", F.lit(1)) * MONTH_DAYS).cast("int")).alias("ends"), "credits"))
    known = events.join(credits_of, "code", "left").join(own, "user_id").join(F.broadcast(free))
    known = known.withColumns({"day": F.to_date("at"), "place": F.struct("at", "event_id")})
    attempt = ~F.col("staff") & (F.col("kind") == "answered")
    blocks = scans.in_blocks(known, "user_id", F.floor(F.unix_timestamp("at") / BLOCK_SECONDS))
    read = scans.scanned(blocks, "user_id", "place", {"held": begun}, {"charges": F.when(attempt, 1)}, {"day_before": F.col("day")})
    begun_before, held = F.col("held").isNotNull(), F.coalesce("held", "first_plan")
    ended = lambda day: (held["plan"] != FREE) & F.coalesce(held["ends"] < day, F.lit(False))
    own_credits = F.coalesce(held["credits"], F.col("free_credits"))
    read = read.withColumns({
        "ended": ended(F.col("day")), "ends_now": ended(F.col("day")) & ~F.coalesce(ended(F.col("day_before")), F.lit(False)),
        # every access leaves the month of its day or, until a plan has begun or ended, a later one that there was at first
        "set_on": F.when(begun_before | F.coalesce(ended(F.col("day_before")), F.lit(False)), F.col("day_before")).otherwise(F.greatest("first_set_on", "day_before")), "plan_now": held["plan"], "credits_now": own_credits,
    })
    month = F.col("set_on").isNull() | (F.trunc("set_on", "MM") < F.trunc("day", "MM"))
    setting = (
        F.when(F.col("kind") == "plan", F.col("credits_now") * F.coalesce("months", F.lit(1))).when(F.col("ends_now"), F.col("free_credits")).when(month, F.when(F.col("ended"), F.col("free_credits")).otherwise(F.col("credits_now")))
    )
    own_charge = F.when(F.coalesce(attempt, F.lit(False)), 1).otherwise(0)
    before = F.col("charges") - own_charge
    read = scans.scanned(read.withColumn("charges_before", before), "user_id", "place", {"setting": F.when(setting.isNotNull(), F.struct(setting.cast("long").alias("value"), F.col("charges_before").alias("at")))})
    base, since = F.coalesce(F.col("setting.value"), F.col("first_quota")), F.coalesce(F.col("setting.at"), F.lit(0))
    asked = F.col("kind").isin("answered", "unanswered")
    allowed = F.when(asked, F.col("staff") | (_left(base, F.col("charges_before") - since) > 0))
    quota = _left(base, F.col("charges") - since)
    plan = F.when(F.col("ended"), FREE).otherwise(F.col("plan_now"))
    return read.select("event_id", "user_id", plan.alias("plan"), allowed.alias("allowed"), F.when(allowed & (own_charge == 1), 1).otherwise(0).alias("cost"), quota.alias("quota"))
