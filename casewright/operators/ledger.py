"""The cost ledger: pricing, appends, totals, calendar-filled series, budget states, estimates."""

from __future__ import annotations

import tomllib
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MONEY = "decimal(20,10)"
# Dollars for a million tokens, and those of an unknown model.
RATES = [
    ("anthropic", "claude-opus-4-7", "15.00", "75.00"), ("anthropic", "claude-sonnet-4-6", "3.00", "15.00"), ("anthropic", "claude-haiku-4-5", "1.00", "5.00"), ("voyage", "voyage-3", "0.06", "0.00"),
]
UNKNOWN = ("20.00", "100.00")


def rates(path: str | None = None) -> tuple[list[tuple[str, str, str, str]], tuple[str, str]]:
    """Rates from a TOML file of [provider.model] tables; the fixed ones on any error."""
    try:
        with open(path or "", "rb") as f:
            doc = tomllib.load(f)
        fall = doc.pop("conservative_default", {})

        def cell(table: dict, key: str) -> str:
            if isinstance(table[key], bool):
                raise TypeError(key)
            return str(Decimal(str(table[key])))

        tables = [(p, m, v) for p, models in doc.items() if isinstance(models, dict) for m, v in models.items() if isinstance(v, dict)]
        rows = [(p.lower(), m.lower(), cell(v, "input_per_mtok"), cell(v, "output_per_mtok")) for p, m, v in tables]
        return rows, (cell(fall, "input_per_mtok"), cell(fall, "output_per_mtok")) if fall else UNKNOWN
    except (OSError, tomllib.TOMLDecodeError, KeyError, AttributeError, TypeError, ArithmeticError):
        return RATES, UNKNOWN


def priced(spark: SparkSession, events: DataFrame, book=(RATES, UNKNOWN)) -> DataFrame:
    """Add input, output and total cost by (provider, model); cached calls cost nothing. The price list is a few rows."""
    rows, fall = book
    prices = spark.createDataFrame([(p.lower(), m.lower(), i, o) for p, m, i, o in rows], "_p string, _m string, _i string, _o string")
    df = events.join(F.broadcast(prices), (F.lower("provider") == F.col("_p")) & (F.lower("model") == F.col("_m")), "left")
    cost = lambda rate, default, tokens: F.when(F.col("cached"), F.lit(0)).otherwise(
        F.coalesce(F.col(rate), F.lit(default)).cast("decimal(10,2)") * F.col(tokens).cast("decimal(12,0)") * F.lit(Decimal("0.000001")).cast("decimal(7,6)")
    ).cast(MONEY)
    df = df.withColumns({"input_cost_usd": cost("_i", fall[0], "input_tokens"), "output_cost_usd": cost("_o", fall[1], "output_tokens")})
    return df.withColumn("total_cost_usd", (F.col("input_cost_usd") + F.col("output_cost_usd")).cast(MONEY)).drop("_p", "_m", "_i", "_o")


def _sum(col: str = "total_cost_usd") -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("decimal(30,10)")


def lifetime_total(events: DataFrame) -> DataFrame:
    return events.agg(_sum().alias("total"))


def session_total(events: DataFrame, session: int | str) -> DataFrame:
    return lifetime_total(events.where(F.col("session_id") == session))


def session_tokens(events: DataFrame, session: int | str) -> DataFrame:
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return events.where(F.col("session_id") == session).agg(total("input_tokens"), total("output_tokens"))


def per_feature(events: DataFrame, since: str | None = None) -> DataFrame:
    rows = events.where(F.col("ts") >= F.lit(since).cast("timestamp_ntz")) if since else events
    return rows.groupBy("feature").agg(_sum().alias("total"))


def per_day(events: DataFrame, days: int, now: str) -> DataFrame:
    """One row a day for ``days`` days up to ``now``, zeros included, oldest first; none for days <= 0."""
    spark = events.sparkSession
    today = F.lit(now).cast("date")
    calendar = spark.range(max(days, 0)).select(F.date_sub(today, (F.lit(max(days, 1) - 1) - F.col("id")).cast("int")).alias("day"))
    totals = events.where((F.to_date("ts") <= today) & (F.to_date("ts") > F.date_sub(today, max(days, 0)))).groupBy(F.to_date("ts").alias("day")).agg(_sum().alias("t"))
    return calendar.join(F.broadcast(totals), "day", "left").select("day", F.coalesce("t", F.lit(0)).cast("decimal(30,10)").alias("total"))


def month_to_date(events: DataFrame, now: str) -> DataFrame:
    """The sum since the month's first day; later events count as well."""
    return lifetime_total(events.where(F.col("ts") >= F.date_trunc("month", F.lit(now).cast("timestamp_ntz"))))


def budget_status(events: DataFrame, cap: str | None, now: str) -> DataFrame:
    """off, ok, warning from 80 %, exceeded from 100 % of the cap; a cap that is absent, not positive or no number is off."""
    try:
        limit = Decimal(cap or "0")
    except ArithmeticError:
        limit = Decimal(0)
    share = F.col("total") / F.lit(limit).cast("decimal(20,4)") if limit > 0 else F.lit(None).cast("double")
    state = F.when(share.isNull(), "off").when(share >= 1, "exceeded").when(share >= Decimal("0.8"), "warning").otherwise("ok")
    return month_to_date(events, now).select(F.col("total").alias("spent"), state.alias("state"))


def recent(events: DataFrame, limit: int = 50, feature: str | None = None, cached: bool | None = None) -> DataFrame:
    rows = events if feature is None else events.where(F.col("feature") == feature)
    rows = rows if cached is None else rows.where(F.col("cached") == cached)
    return rows.orderBy(F.desc("ts"), F.desc("id")).limit(limit)


def export_csv(events: DataFrame, path: str, feature: str | None = None, cached: bool | None = None, most: int = 100_000) -> None:
    """The newest rows as CSV: thirteen fixed columns, empty for a null artifact, true or false."""
    cols = ["id", "ts", "session_id", "model", "provider", "input_tokens", "output_tokens", "input_cost_usd", "output_cost_usd", "total_cost_usd", "feature", "artifact_id", "cached"]
    recent(events, most, feature, cached).select(*cols).write.mode("overwrite").option("header", True).csv(path)


def append(events: DataFrame, ledger: str, book=(RATES, UNKNOWN)) -> None:
    priced(events.sparkSession, events, book).write.mode("append").parquet(ledger)


# -- estimates ------------------------------------------------------------------------------------------

# The model, tokens and band of each estimated feature.
ESTIMATES = {
    "book_ingestion": ("claude-sonnet-4-6", 2000, 1000, "0.50"), "case_brief": ("claude-opus-4-7", 1500, 1200, "0.30"), "bulk_brief_generation": ("claude-opus-4-7", 1500, 1200, "0.30"),
    "outline_regeneration": ("claude-opus-4-7", 500, 8000, "0.30"), "rubric_from_memo": ("claude-opus-4-7", 4000, 2000, "0.30"),
}


def estimate(requests: DataFrame) -> DataFrame:
    """Expected cost and its band for rows of (feature, units): low, expected, high to four decimals (half to even), and a label.

    ``units`` are pages for a book, cases for bulk briefs, artifacts for an outline, else ignored.
    """
    cost = {m: (Decimal(i), Decimal(o)) for _, m, i, o in RATES}
    exp, pct = F.lit(None).cast("decimal(30,12)"), F.lit(None).cast("decimal(4,2)")
    for name, (model, tin, tout, band) in ESTIMATES.items():
        i, o = (c / Decimal(10**6) for c in cost[model])
        n = F.col("units").cast("decimal(10,0)")
        lit = lambda d: F.lit(d).cast("decimal(18,8)")
        each = tin * i + tout * o
        value = {
            "book_ingestion": n * lit(each * Decimal("0.10")), "bulk_brief_generation": n * lit(each), "outline_regeneration": n * lit(tin * i) + lit(tout * o),
        }.get(name, lit(each))
        exp = F.when(F.col("feature") == name, value.cast("decimal(30,12)")).otherwise(exp)
        pct = F.when(F.col("feature") == name, F.lit(Decimal(band)).cast("decimal(4,2)")).otherwise(pct)
    four = lambda c: F.bround(c.cast("decimal(30,12)"), 4).cast("decimal(20,4)")
    known = exp.isNotNull()
    money = lambda c, d: F.when(known, four(c)).otherwise(F.lit(Decimal(d))).cast("decimal(20,4)")
    out = requests.withColumns({"low": money(exp * (1 - pct), "0.10"), "expected": money(exp, "1.00"), "high": money(exp * (1 + pct), "10.00")})
    label = F.concat(F.lit("~$"), F.bround("expected", 2).cast("decimal(20,2)").cast("string"), F.lit(" (±"), (F.coalesce(pct, F.lit(Decimal("9.00"))) * 100).cast("int").cast("string"), F.lit("%)"))
    unknown = F.concat(F.lit("unknown feature '"), F.coalesce("feature", F.lit("")), F.lit("': "))
    return out.withColumn("label", F.concat(F.when(known, "").otherwise(unknown), label))
