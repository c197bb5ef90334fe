"""Pay and cost functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import let

#: Currency signs and names.
CURRENCIES = {
    "$": "USD", "usd": "USD", "us$": "USD", "€": "EUR", "eur": "EUR", "£": "GBP", "gbp": "GBP", "₹": "INR", "inr": "INR", "rs": "NPR", "rs.": "NPR", "npr": "NPR",
    "aud": "AUD", "cad": "CAD", "sgd": "SGD", "aed": "AED",
}
#: Wordings of pay periods, in order.
PERIODS = {
    "hour": r"per hour|/\s*h(?:ou)?r\b|hourly|an hour|/h\b",
    "day": r"per day|/\s*day|daily|a day",
    "week": r"per week|/\s*w(?:ee)?k\b|weekly",
    "month": r"per month|/\s*mo(?:nth)?\b|monthly|a month|p\.?m\.?\b",
    "year": r"per year|/\s*y(?:ea)?r\b|annual|annually|per annum|a year|yearly|p\.?a\.?\b",
}
#: months' worth of one period.
MONTHLY = {"hour": 160.0, "day": 21.67, "week": 4.33, "month": 1.0, "year": 1 / 12}
#: How pay is written; what is read must agree with it.
SIGN = r"(?:us\$|[$€£₹]|\brs\.?|\b(?:usd|eur|gbp|inr|npr|aud|cad|sgd|aed)\b)"
AMOUNT = r"\d[\d,]*(?:\.\d+)?"
SALARY = rf"(?i)({SIGN})\s*({AMOUNT})\s*(k\b)?(?:\s*(?:-|–|—|to)\s*(?:{SIGN})?\s*({AMOUNT})\s*(k\b)?)?([^\n]{{0,40}})"


def lookup(values: dict[str, float | str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), key)


def salary(text: Column, base_currency: str = "NPR") -> Column:
    """struct(min, max, currency, period) of the first pay in a text, null if there is none."""
    group = lambda i: F.nullif(F.regexp_extract(text, SALARY, i), F.lit(""))
    number = lambda i: F.replace(group(i), F.lit(","), F.lit("")).try_cast("double")
    found = F.struct(
        (number(2) * F.when(group(3).isNotNull(), 1000).otherwise(1)).alias("min"),
        (number(4) * F.when(F.coalesce(group(5), group(3)).isNotNull(), 1000).otherwise(1)).alias("max"),
        F.coalesce(lookup(CURRENCIES, F.lower(F.trim(group(1)))), F.lit("USD")).alias("currency"),
        let(F.lower(group(6)), lambda tail: F.coalesce(*[F.when(tail.rlike(p), F.lit(k)) for k, p in PERIODS.items()])).alias("stated"),
    )

    def complete(s: Column) -> Column:
        size = F.coalesce(F.nullif(s["max"], F.lit(0.0)), s["min"])
        home = F.when(size >= 600_000, "year").otherwise("month")
        guessed = F.when(s["currency"] == base_currency, home).when(size < 250, "hour").when(size < 20_000, "month").otherwise("year")
        return F.when(s["min"] > 0, F.struct(s["min"].alias("min"), s["max"].alias("max"), s["currency"].alias("currency"), F.coalesce(s["stated"], guessed).alias("period")))

    return let(found, complete)


def monthly(amount: Column, currency: Column, period: Column, fx: dict[str, float]) -> Column:
    """Amount a month in the base currency, rounded half to even; null for unknown currencies or periods."""
    return F.bround(amount * lookup(fx, F.upper(currency)) * lookup(MONTHLY, F.coalesce(F.nullif(period, F.lit("")), F.lit("year"))), 0)


def resolved(low: Column, high: Column, currency: Column, period: Column, text: Column, base_currency: str = "NPR") -> Column:
    """Stated bounds if there are any, else what the text says; the period defaults to a year."""
    found = salary(text, base_currency)
    read = low.isNull() & high.isNull() & found.isNotNull()
    return F.struct(
        F.when(read, found["min"]).otherwise(low).alias("min"),
        F.when(read, found["max"]).otherwise(high).alias("max"),
        F.when(read, found["currency"]).otherwise(currency).alias("currency"),
        F.coalesce(F.when(read, found["period"]).otherwise(period), F.lit("year")).alias("period"),
    )


def pay_label(low: Column, high: Column, currency: str = "NPR") -> Column:
    whole = lambda c: F.format_number(c, 0)
    both = F.concat(whole(low), F.lit("-"), whole(high))
    return F.when(low.isNull() & high.isNull(), "").otherwise(F.concat(F.lit(f"{currency} "), F.when(low.isNotNull() & high.isNotNull() & (low != high), both).otherwise(whole(F.coalesce(low, high))), F.lit("/mo")))


def usage_cost(tokens_in: Column, cache_write: Column, cache_read: Column, tokens_out: Column, searches: Column, price_in: Column, price_out: Column, per_1000_searches: float) -> Column:
    """Cost of a call: cache writes at 1.25, cache reads at 0.1 of the input price."""
    tokens = (tokens_in + 1.25 * cache_write + 0.1 * cache_read) * price_in + tokens_out * price_out
    return tokens / 1e6 + searches * per_1000_searches / 1000


def cached_usage_cost(prompt: Column, cached: Column, completion: Column, price_in: Column, price_out: Column) -> Column:
    """Cost where cached prompt tokens count a quarter."""
    return (F.greatest(F.lit(0), prompt - cached) * price_in + 0.25 * cached * price_in + completion * price_out) / 1e6
