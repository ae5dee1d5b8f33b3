"""Plans, quotas, requests, reports and accounts, as rewrites of tables.

"Today" is always a parameter. An operator that a user may not apply leaves the row as it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Cost of a question, least margin, days of a month, the seed catalogue, preferences and their defaults.
QUESTION_COST, LEAST_MARGIN, MONTH_DAYS, FREE = 25, 0.50, 30, "gratuit"
PLANS = [("gratuit", 0, 10, False, 10), ("essentiel", 5000, 90, False, 20), ("cabinet", 8000, 150, False, 30), ("essai", 25, 1, True, 40)]
PREFERENCES = {"salutation": "true", "veille_active": "true", "format_export": "pdf", "extraits_entiers": "false", "densite": "confortable"}
PREFERENCE_VALUES = {"salutation": ["true", "false"], "veille_active": ["true", "false"], "format_export": ["pdf", "docx"], "extraits_entiers": ["true", "false"], "densite": ["confortable", "compacte"]}
STAFF = ("juriste", "admin")


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "code string, price int, credits int, trial boolean, position int").withColumn("active", F.lit(True))


def is_staff(role: Column) -> Column:
    return role.isin(*STAFF)


def with_plan(users: DataFrame, catalogue: DataFrame) -> DataFrame:
    """users with plan_credits and plan_price; an unknown plan counts as the free one."""
    known = catalogue.select(F.col("code").alias("plan"), F.col("credits").alias("c"), F.col("price").alias("p"))
    free = catalogue.where(F.col("code") == FREE).agg(F.max("credits").alias("fc"), F.max("price").alias("fp"))
    return users.join(known, "plan", "left").join(F.broadcast(free)).select(*users.columns, F.coalesce("c", "fc").alias("plan_credits"), F.coalesce("p", "fp").alias("plan_price"), F.col("fc").alias("free_credits"))


def refreshed_quotas(users: DataFrame, catalogue: DataFrame, today: Column) -> DataFrame:
    """users(user_id, plan, plan_ends, quota, quota_set_on): an ended plan becomes the free one, with its credits; else a new
    month brings the plan's credits."""
    u = with_plan(users, catalogue)
    ended = (F.col("plan") != FREE) & F.coalesce(F.col("plan_ends") < today, F.lit(False))
    month = F.col("quota_set_on").isNull() | (F.trunc("quota_set_on", "MM") < F.trunc(today, "MM"))
    changed = {
        "quota": F.when(ended, F.col("free_credits")).when(month, F.col("plan_credits")).otherwise(F.col("quota")),
        "quota_set_on": F.when(ended | month, today).otherwise(F.col("quota_set_on")),
        "plan": F.when(ended, F.lit(FREE)).otherwise(F.col("plan")),
        "plan_ends": F.when(ended, F.lit(None)).otherwise(F.col("plan_ends")),
    }
    return u.select(*(changed.get(c, F.col(c)).alias(c) for c in users.columns))


def margins(catalogue: DataFrame) -> DataFrame:
    """code, margin (null if free), acceptable, and the most credits that would be."""
    cost = F.col("credits") * QUESTION_COST
    margin = F.when(F.col("price") != 0, (F.col("price") - cost) / F.col("price"))
    fine = (F.col("price") >= 0) & (F.col("credits") >= 0) & ((F.col("price") == 0) | F.col("trial") | (margin >= LEAST_MARGIN))
    return catalogue.select("code", F.round(margin, 6).alias("margin"), fine.alias("acceptable"), F.floor(F.col("price") * (1 - LEAST_MARGIN) / QUESTION_COST).alias("most_credits"))


def visible_catalogue(catalogue: DataFrame, production: bool) -> DataFrame:
    shown = F.col("active") & (~F.col("trial") if production else F.lit(True))
    return catalogue.where(shown).orderBy("position", "code")


def subscribers(users: DataFrame, catalogue: DataFrame, today: Column) -> DataFrame:
    """code and n: active subscriptions of each plan, zero where there is none."""
    counts = users.where(is_active(today)).groupBy(F.col("plan").alias("code")).agg(F.count("*").alias("n"))
    return catalogue.select("code").join(counts, "code", "left").fillna(0, "n")


def is_active(today: Column) -> Column:
    return (F.col("plan") == FREE) | F.col("plan_ends").isNull() | (F.col("plan_ends") >= today)


def revenue(users: DataFrame, catalogue: DataFrame, today: Column) -> DataFrame:
    """One row: what active paying subscriptions bring."""
    counted = subscribers(users, catalogue, today).join(catalogue.select("code", "price"), "code")
    return counted.agg(F.coalesce(F.sum(F.col("n") * F.col("price")), F.lit(0)).alias("revenue"))


def dashboard(users: DataFrame, texts: DataFrame, articles: DataFrame, messages: DataFrame) -> DataFrame:
    """One row of counters; each table is read once."""
    u = users.agg(F.count("*").alias("users"), F.count_if(is_staff(F.col("role"))).alias("staff"), F.count_if(F.col("suspended_on").isNotNull()).alias("suspended"))
    a = articles.agg(F.count("*").alias("articles"), F.count_if(F.col("repealed_on").isNull()).alias("in_force"), F.count("embedding").alias("vectorised"))
    parts = [u, texts.agg(F.count("*").alias("texts")), a, messages.agg(F.count("*").alias("messages"))]
    return reduce(lambda x, y: x.join(F.broadcast(y)), parts)  # one row each


def users_by_role(users: DataFrame) -> DataFrame:
    """role, n and suspended."""
    return users.groupBy("role").agg(F.count("*").alias("n"), F.count("suspended_on").alias("suspended"))


def by_email(users: DataFrame, asked: DataFrame) -> DataFrame:
    """users with asked, for those of asked(asked) that are their e-mail, whatever its case."""
    return users.join(asked.withColumn("__key", F.lower(F.trim("asked"))), F.lower("email") == F.col("__key")).drop("__key")


def requests_to_accept(requests: DataFrame, pending: DataFrame, users: DataFrame, catalogue: DataFrame) -> DataFrame:
    """request_id and outcome of requests(request_id, user_id, code, asked_at): "unknown_plan", "same_plan", "downgrade",
    "already_pending" or "pending"; of a user's several requests the first counts as pending."""
    joined = requests.join(catalogue.select("code", "price"), "code", "left").join(users.select("user_id", "plan"), "user_id")
    joined = joined.join(pending.select("user_id").distinct().withColumn("waits", F.lit(True)), "user_id", "left")
    paid = F.col("price").isNotNull() & (F.col("code") != F.col("plan")) & (F.col("price") > 0)
    order = Window.partitionBy("user_id").orderBy(F.desc(paid), "asked_at", "request_id")
    joined = joined.withColumn("turn", F.row_number().over(order))
    outcome = F.when(F.col("price").isNull(), "unknown_plan").when(F.col("code") == F.col("plan"), "same_plan").when(F.col("price") == 0, "downgrade")
    return joined.select("request_id", "user_id", outcome.when(F.col("waits") | (F.col("turn") > 1), "already_pending").otherwise("pending").alias("outcome"))


def requests_with_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """The pending ones of requests(request_id, user_id, code, status, asked_at) of users that exist, with email, the oldest first."""
    return requests.where("status = 'pending'").join(users.select("user_id", "email"), "user_id").orderBy("asked_at", "request_id")


def parted(rows: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that are chosen, and all others, those of which nothing is known among them."""
    known = F.coalesce(chosen, F.lit(False))
    return rows.where(known), rows.where(~known)


def downgraded(users: DataFrame, who: DataFrame, catalogue: DataFrame) -> DataFrame:
    """users with those of who(user_id) on the free plan, keeping no more credits than it has."""
    u = with_plan(users, catalogue).join(who.select("user_id").distinct().withColumn("down", F.lit(True)), "user_id", "left")
    down = F.coalesce("down", F.lit(False))
    changed = {"plan": F.when(down, F.lit(FREE)).otherwise(F.col("plan")), "plan_ends": F.when(~down, F.col("plan_ends")), "quota": F.when(down, F.least("quota", "free_credits")).otherwise(F.col("quota"))}
    return u.select(*(changed.get(c, F.col(c)).alias(c) for c in users.columns))


def activated(users: DataFrame, requests: DataFrame, catalogue: DataFrame, today: Column) -> DataFrame:
    """users after their pending requests(user_id, code, status, months) are validated: days and credits for each month.
    A request that is no longer pending changes nothing, so doing this twice is doing it once."""
    due = requests.where("status = 'pending'").join(catalogue.select("code", "credits"), "code").select("user_id", F.col("code").alias("new_plan"), "credits", F.coalesce("months", F.lit(1)).alias("months"))
    joined = users.join(due, "user_id", "left")
    has = F.col("new_plan").isNotNull()
    changed = {
        "plan": F.coalesce("new_plan", "plan"),
        "plan_ends": F.when(has, F.date_add(today, (F.col("months") * MONTH_DAYS).cast("int"))).otherwise(F.col("plan_ends")),
        "quota": F.when(has, F.col("credits") * F.col("months")).otherwise(F.col("quota")).cast("int"),
    }
    return joined.select(*(changed.get(c, F.col(c)).alias(c) for c in users.columns))


def payment_states(events: DataFrame) -> DataFrame:
    """reference and status: the final status once there is one, whatever comes later, else the last of
    events(reference, status, at); repeated events change nothing."""
    final = F.col("status").isin("SUCCESSFUL", "FAILED")
    first_final = F.min_by(F.when(final, F.col("status")), F.when(final, F.struct("at", "status")))
    return events.groupBy("reference").agg(F.coalesce(first_final, F.max_by("status", F.struct("at", "status"))).alias("status"))


def handled_reports(reports: DataFrame, decisions: DataFrame, at: Column) -> DataFrame:
    """reports(report_id, status, correction, handled_at) after decisions(report_id, status, correction): open ones only,
    and only with a correction if they are treated."""
    d = decisions.where((F.col("status") != "treated") | (F.trim(F.coalesce("correction", F.lit(""))) != "")).select("report_id", F.col("status").alias("to"), F.col("correction").alias("with"))
    joined = reports.join(d, "report_id", "left")
    done = (F.col("status") == "open") & F.col("to").isNotNull()
    changed = {"status": F.when(done, F.col("to")), "correction": F.when(done, F.col("with")), "handled_at": F.when(done, at)}
    return joined.select(*(F.coalesce(changed[c], F.col(c)).alias(c) if c in changed else F.col(c) for c in reports.columns))


def removable_accounts(users: DataFrame, deposits: DataFrame, who: DataFrame) -> DataFrame:
    """user_id and reason why each of who(user_id) must stay ("last_admin", "has_deposits"), null if it may go."""
    admins = users.where((F.col("role") == "admin") & F.col("suspended_on").isNull()).agg(F.count("*").alias("admins"))
    held = deposits.select(F.explode(F.array("deposited_by", "decided_by")).alias("user_id")).where("user_id IS NOT NULL").distinct().withColumn("held", F.lit(True))
    joined = who.join(users.select("user_id", "role", "suspended_on"), "user_id").join(held, "user_id", "left").join(F.broadcast(admins))
    last = (F.col("role") == "admin") & F.col("suspended_on").isNull() & (F.col("admins") <= 1)
    return joined.select("user_id", F.when(last, "last_admin").when(F.col("held"), "has_deposits").alias("reason"))


def with_roles(users: DataFrame, changes: DataFrame) -> DataFrame:
    """users with the roles of changes(user_id, role), unless that leaves no admin."""
    joined = users.join(changes.select("user_id", F.col("role").alias("to")), "user_id", "left").withColumn("new", F.coalesce("to", "role"))
    left = joined.agg(F.count_if(F.col("new") == "admin").alias("admins"))
    kept = F.when(F.col("admins") > 0, F.col("new")).otherwise(F.col("role"))
    return joined.join(F.broadcast(left)).select(*(kept.alias("role") if c == "role" else F.col(c) for c in users.columns)).orderBy("user_id")


def catalogue_changes(catalogue: DataFrame, changes: DataFrame) -> DataFrame:
    """code and problem (null if acceptable) of changes(code, price, credits, trial, active, is_new)."""
    joined = changes.join(catalogue.select("code", F.lit(True).alias("there")), "code", "left")
    checked = joined.join(margins(changes).select("code", "acceptable"), "code")
    problem = F.when(F.col("is_new") & F.col("there"), "code_taken").when(~F.col("is_new") & F.col("there").isNull(), "unknown_code").when((F.col("code") == FREE) & ~F.col("active"), "free_must_stay").when(~F.col("acceptable"), "margin_too_low")
    return checked.select("code", problem.alias("problem"))


def without_conversation(conversations: DataFrame, messages: DataFrame, citations: DataFrame, conversation_id: int, owner: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after an owner deletes a conversation: citations, then messages, then the conversation."""
    gone = conversations.where((F.col("conversation_id") == conversation_id) & (F.col("user_id") == owner)).select("conversation_id")
    gone_messages = messages.join(gone, "conversation_id", "left_semi").select("message_id")
    return conversations.join(gone, "conversation_id", "left_anti"), messages.join(gone, "conversation_id", "left_anti"), citations.join(gone_messages, "message_id", "left_anti")


def flagged(favourites: DataFrame, articles: DataFrame, texts: DataFrame) -> DataFrame:
    """user_id, article_id, repealed and revised of every favourite whose article is there."""
    joined = favourites.join(articles.select(F.col("id").alias("article_id"), "text_id", "repealed_on"), "article_id").join(texts.select(F.col("id").alias("text_id"), "version"), "text_id")
    seen = F.when(F.col("seen_version") != "", F.col("seen_version"))
    return joined.select("user_id", "article_id", F.col("repealed_on").isNotNull().alias("repealed"), (seen.isNotNull() & (seen != F.col("version"))).alias("revised"))


def alerts(favourites: DataFrame, articles: DataFrame, texts: DataFrame) -> DataFrame:
    """user_id, article_id, acronym, number and reason of favourites(user_id, article_id, seen_version) whose article is
    repealed or whose text has another version than was seen; repeal goes before revision. An empty version was not seen."""
    joined = favourites.join(articles.select(F.col("id").alias("article_id"), "text_id", "number", "repealed_on"), "article_id")
    joined = joined.join(texts.select(F.col("id").alias("text_id"), "acronym", "version"), "text_id")
    seen = F.when(F.col("seen_version") != "", F.col("seen_version"))
    reason = F.when(F.col("repealed_on").isNotNull(), "repealed").when(seen.isNotNull() & (seen != F.col("version")), "revised")
    return joined.select("user_id", "article_id", "acronym", "number", reason.alias("reason")).where("reason IS NOT NULL")


def preferences(stored: Column) -> Column:
    """Stored preferences (map<string,string>) with the defaults of those that are missing."""
    defaults = F.create_map(*(F.lit(x) for kv in PREFERENCES.items() for x in kv))
    return F.map_from_arrays(F.map_keys(defaults), F.transform(F.map_keys(defaults), lambda k: F.coalesce(F.try_element_at(stored, k), defaults[k])))


def preference_problems(proposed: Column) -> Column:
    """Keys of a proposed map that are unknown, or whose value is not among those allowed."""
    allowed = F.create_map(*(x for k, vs in PREFERENCE_VALUES.items() for x in (F.lit(k), F.array(*map(F.lit, vs)))))
    return F.array_sort(F.filter(F.map_keys(proposed), lambda k: ~F.coalesce(F.array_contains(F.try_element_at(allowed, k), proposed[k]), F.lit(False))))


def upserted(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing with new rows put in or over those with their keys: created_at is the first one's, modified_at is set only
    on rows that are replaced. Both have keys, created_at and modified_at."""
    all_rows = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    latest = Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc("created_at"))
    whole = Window.partitionBy(*keys)
    ranked = all_rows.withColumns({"__r": F.row_number().over(latest), "__first": F.min("created_at").over(whole), "__n": F.count("*").over(whole)})
    kept = ranked.where("__r = 1")
    changed = {"created_at": F.col("__first"), "modified_at": F.when((F.col("__new") == 1) & (F.col("__n") > 1), F.col("created_at")).otherwise(F.col("modified_at"))}
    return kept.select(*(changed.get(c, F.col(c)).alias(c) for c in existing.columns))


def seeded(existing: DataFrame, seed: DataFrame, keys: list[str]) -> DataFrame:
    """existing, and those rows of seed whose keys it lacks."""
    return existing.unionByName(seed.join(existing.select(*keys), keys, "left_anti").select(*existing.columns))
