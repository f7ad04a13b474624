"""Time-aware scoring as column expressions. All of them take the time "now" as a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Share of its weight that an item loses per day; weights of the confidence levels.
DECAY_RATE = 0.05
LEVEL_WEIGHT = {"Highest": 1.2, "High": 1.0, "Medium": 0.85, "Low": 0.6, "Lowest": 0.4}


def epoch(ts: Column) -> Column:
    """Whole seconds since 1970, rounded down."""
    return F.unix_seconds(ts.cast("timestamp"))


def age_days(ts: Column, now: Column) -> Column:
    """Whole days, toward zero; times at or before 1970 and null times have age 0."""
    days = F.try_divide(epoch(now) - epoch(ts), F.lit(86400))
    whole = F.when(days >= 0, F.floor(days)).otherwise(F.ceil(days))
    return F.when(epoch(ts) > 0, whole).otherwise(F.lit(0)).cast("bigint")


def decay(age: Column, rate: float = DECAY_RATE) -> Column:
    """Exponential decay; ages below 0 count as 0."""
    return F.exp(-F.lit(rate) * F.greatest(age, F.lit(0)))


def confidence_level(content_type: Column, age: Column, is_current: Column) -> Column:
    """Code is trusted while current, history always, and talk for as long as it is fresh."""
    talk = F.when(age <= 7, "Medium").when(age <= 30, "Low").otherwise("Lowest")
    code = F.when(F.coalesce(is_current, F.lit(True)), "Highest").otherwise("Low")
    return F.when(content_type.isin("File", "Symbol"), code).when(content_type.isin("Commit", "GitDiff", "Plan"), "High").when(content_type.isin("Message", "Session"), talk)


def base_weight(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LEVEL_WEIGHT.items() for x in kv])[level]


def final_score(similarity: Column, age: Column, weight: Column, rate: float = DECAY_RATE) -> Column:
    return similarity * decay(age, rate) * weight


def in_range(ts: Column, content_type: Column, after: Column | None = None, before: Column | None = None) -> Column:
    """``after <= ts < before``; symbols have no time of their own and always pass."""
    inside = F.lit(True)
    if after is not None:
        inside = inside & (ts >= after)
    if before is not None:
        inside = inside & (ts < before)
    return (content_type == "Symbol") | inside


def _plural(n: Column, unit: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, f" {unit} ago").otherwise(f" {unit}s ago"))


def age_text_days(age: Column) -> Column:
    """Current, then days up to 59, then months of 30 days; negative ages in hours."""
    text = F.when(age < 1, F.concat((age * 24).cast("string"), F.lit(" hours ago"))).when(age < 60, F.concat(age.cast("string"), F.lit(" days ago"))).otherwise(F.concat(F.floor(age / 30).cast("string"), F.lit(" months ago")))
    return F.when(age == 0, "Current").otherwise(text)


def age_text_long(seconds: Column) -> Column:
    """From "Just now" over hours, days and weeks to months."""
    hours, days = F.floor(seconds / 3600), F.floor(seconds / 86400)
    return F.when(hours < 1, "Just now").when(hours < 24, _plural(hours, "hour")).when(days < 7, _plural(days, "day")).when(days < 30, _plural(F.floor(days / 7), "week")).otherwise(_plural(F.floor(days / 30), "month"))


def age_text_short(seconds: Column) -> Column:
    """Like 5m, 3h, 2d or 7w ago."""
    def part(unit: int, letter: str) -> Column:
        return F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{letter} ago"))

    return F.when(seconds < 60, "just now").when(seconds < 3600, part(60, "m")).when(seconds < 86400, part(3600, "h")).when(seconds < 604800, part(86400, "d")).otherwise(part(604800, "w"))
