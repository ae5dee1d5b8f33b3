"""Rule-based amounts. Rates must stand in the cited article, else there is no result.

Amounts are decimals throughout and are rounded half up to whole units only when shown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import amount_pattern, grouped_digits, rate_pattern, stated_rates

AMOUNT = "decimal(38,10)"
# The declared rates, brackets and tariffs, and the articles that carry them.
LARGEST = 10**15
RATES = [("vat", "17.5", "142"), ("company", "30", "17"), ("surcharge", "10", "C 54")]
BRACKETS = [(2_000_000, "10"), (3_000_000, "15"), (5_000_000, "25"), (None, "35")]
BRACKET_ARTICLE = "69"
TARIFFS = [
    ("large", "0.159", 5_000_000, 2_500_000_000, "2,5 milliards"),
    ("medium", "0.283", 141_500, 4_500_000, "4 500 000"),
    ("small", "0.494", 50_000, 140_000, "140 000"),
]
TARIFF_ARTICLE = "C 13"


def amount(c: Column) -> Column:
    """c as an amount; null unless it is a number from 0 to LARGEST."""
    value = c.try_cast(AMOUNT)
    return F.when((value >= 0) & (value <= F.lit(LARGEST)), value)


def shown(c: Column) -> Column:
    return F.round(c.cast(AMOUNT), 0).cast("long")


def rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RATES, "name string, rate string, number string").withColumns({"written": F.col("rate"), "rate": F.col("rate").cast("decimal(10,4)")})


def brackets(spark: SparkSession) -> DataFrame:
    rows = [(i, ceiling, rate, rate_pattern(rate), None if ceiling is None else amount_pattern(ceiling)) for i, (ceiling, rate) in enumerate(BRACKETS, 1)]
    typed = spark.createDataFrame(rows, "seq int, ceiling long, rate string, rate_pattern string, ceiling_pattern string")
    floor = F.coalesce(F.lag("ceiling").over(Window.partitionBy(F.lit(0)).orderBy(F.asc_nulls_last("ceiling"))), F.lit(0))  # one row a bracket
    return typed.withColumns({"rate": F.col("rate").cast("decimal(10,4)"), "ceiling": F.col("ceiling").cast(AMOUNT), "floor": floor.cast(AMOUNT)})


def tariffs(spark: SparkSession) -> DataFrame:
    squeezed = lambda s: r"(?iU)" + r"[\s., ]*".join(c.replace(",", r"\,") for c in s if not c.isspace())
    rows = [(name, rate, low, high, rate_pattern(rate), amount_pattern(low), squeezed(written)) for name, rate, low, high, written in TARIFFS]
    typed = spark.createDataFrame(rows, "category string, rate string, low long, high long, rate_pattern string, low_pattern string, high_pattern string")
    return typed.withColumns({"rate": F.col("rate").cast("decimal(10,4)"), "low": F.col("low").cast(AMOUNT), "high": F.col("high").cast(AMOUNT)})


def verified_rates(declared: DataFrame, articles: DataFrame) -> DataFrame:
    """declared(name, rate, number, written) with legal: whether the article in force with that number states the rate as it is
    written, with a point or a comma. An article's rates are taken from it once, however many ask for them."""
    first = articles.groupBy("number").agg(F.min_by("content", "id").alias("content"))
    stated = first.select("number", stated_rates(F.col("content")).alias("stated"))
    joined = declared.join(stated, "number", "left")
    return joined.withColumn("legal", F.coalesce(F.array_contains("stated", F.col("written")), F.lit(False))).drop("stated", "written")


def verified_brackets(declared: DataFrame, content: Column) -> Column:
    """Whether content states every rate and every ceiling of BRACKETS."""
    tests = [content.rlike(rate_pattern(rate)) for _, rate in BRACKETS] + [content.rlike(amount_pattern(c)) for c, _ in BRACKETS if c is not None]
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return F.coalesce(out, F.lit(False))


def _lines(base: DataFrame, *lines: tuple[str, Column]) -> DataFrame:
    return base.select("id", F.inline(F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(label).alias("label"), shown(value).alias("amount")) for i, (label, value) in enumerate(lines, 1)))))


def vat(bases: DataFrame, rate: str = "17.5", surcharge: str = "10", from_gross: bool = False) -> DataFrame:
    """id, seq, label and amount of bases(id, amount): net, principal, surcharge, gross."""
    valid = bases.select("id", amount(F.col("amount")).alias("given")).where("given IS NOT NULL")
    r, s = F.lit(rate).cast("decimal(10,4)") / 100, F.lit(surcharge).cast("decimal(10,4)") / 100
    coefficient = (r * (1 + s)).cast("decimal(18,10)")
    net = (F.col("given") / (1 + coefficient)).cast(AMOUNT) if from_gross else F.col("given")
    valid = valid.withColumn("net", net).withColumn("principal", (F.col("net") * r).cast(AMOUNT)).withColumn("extra", (F.col("principal") * s).cast(AMOUNT))
    gross = F.col("given") if from_gross else F.col("net") + F.col("principal") + F.col("extra")
    return _lines(valid, ("net", F.col("net")), ("principal", F.col("principal")), ("surcharge", F.col("extra")), ("gross", gross))


def proportional(bases: DataFrame, rate: str = "30", surcharge: str | None = "10") -> DataFrame:
    """id, seq, label and amount: base, principal, surcharge (if any), total."""
    valid = bases.select("id", amount(F.col("amount")).alias("base")).where("base IS NOT NULL")
    valid = valid.withColumn("principal", (F.col("base") * F.lit(rate).cast("decimal(10,4)") / 100).cast(AMOUNT))
    extra = (F.col("principal") * F.lit(surcharge or "0").cast("decimal(10,4)") / 100).cast(AMOUNT)
    lines = [("base", F.col("base")), ("principal", F.col("principal"))] + ([("surcharge", extra)] if surcharge else []) + [("total", F.col("principal") + extra)]
    return _lines(valid, *lines)


def progressive(bases: DataFrame, scale: DataFrame, surcharge: str | None = "10") -> DataFrame:
    """id, seq, label and amount: a line for each bracket of scale(seq, floor, ceiling, rate) that the base reaches, and the
    total with its surcharge as seq 0."""
    # the brackets as an array in one row: neither a join of ranges nor a shuffle, and each base's parts are added in its row
    held = scale.agg(F.array_sort(F.collect_list(F.struct("floor", "seq", "ceiling", F.col("rate").cast(AMOUNT).alias("rate")))).alias("scale"))
    valid = bases.select("id", amount(F.col("amount")).alias("base")).where("base IS NOT NULL").join(held)
    reached = F.filter("scale", lambda b: F.col("base") > b["floor"])
    part = lambda b: ((F.least(F.col("base"), F.coalesce(b["ceiling"], F.col("base"))) - b["floor"]) * b["rate"].cast("decimal(10,4)") / 100).cast(AMOUNT)
    label = lambda b: F.when(b["ceiling"].isNotNull(), F.concat(F.lit("up to "), grouped_digits(b["ceiling"]))).otherwise(F.concat(F.lit("beyond "), grouped_digits(b["floor"])))
    lines = valid.select("id", F.transform(reached, lambda b: F.struct(b["seq"].alias("seq"), label(b).alias("label"), part(b).alias("part"))).alias("lines"))
    factor = 1 + F.lit(surcharge or "0").cast("decimal(10,4)") / 100
    total = F.aggregate("lines", F.lit(0).cast(AMOUNT), lambda s, x: (s + x["part"]).cast(AMOUNT)) * factor
    shown_lines = F.transform("lines", lambda x: F.struct(x["seq"].alias("seq"), x["label"].alias("label"), shown(x["part"]).alias("amount")))
    first = F.array(F.struct(F.lit(0).alias("seq"), F.lit("total").alias("label"), shown(total).alias("amount")))
    return lines.select("id", F.inline(F.concat(first, shown_lines)))


def tariff(bases: DataFrame, categories: DataFrame) -> DataFrame:
    """id, category, theoretical, due and bound ("low", "high" or null) of bases(id, category, amount)."""
    valid = bases.select("id", "category", amount(F.col("amount")).alias("base")).where("base IS NOT NULL").join(categories, "category")
    due = (F.col("base") * F.col("rate") / 100).cast(AMOUNT)
    bound = F.when(due < F.col("low"), "low").when(due > F.col("high"), "high")
    return valid.select("id", "category", shown(due).alias("theoretical"), shown(F.least(F.greatest(due, "low"), "high")).alias("due"), bound.alias("bound"))


def availability(declared: DataFrame, articles: DataFrame) -> DataFrame:
    """name, available and reason of each declared rate."""
    present = articles.select("number").distinct().withColumn("there", F.lit(True))
    joined = verified_rates(declared, articles).join(present, "number", "left")
    reason = F.when(F.col("there").isNull(), "article missing").when(~F.col("legal"), "rate not stated")
    return joined.select("name", F.col("legal").alias("available"), reason.alias("reason"))
