"""Small scalar functions: times, labels, sequence numbers, clamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def epoch_ms(ts: Column) -> Column:
    """Epoch milliseconds, rounded down."""
    return F.unix_millis(ts.cast("timestamp"))


def iso_text(ms: Column) -> Column:
    """Epoch milliseconds to ISO text with milliseconds and ``Z``."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def clamp(value: Column, low: Column, high: Column) -> Column:
    """``low`` wins over ``value``, then ``high`` wins over both."""
    return F.least(high, F.greatest(low, value))


def type_label(type_name: Column) -> Column:
    """``pull_request`` -> ``Pull Request``; the rest of each word is unchanged."""
    return F.array_join(
        F.transform(
            F.split(type_name, "_"),
            lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))),
        ),
        " ",
    )


def age_text(at_ms: Column, now_ms: Column) -> Column:
    """Relative age: Never / Just now / minutes / hours / days."""
    seconds = F.floor((now_ms - at_ms) / 1000)
    minutes, hours, days = (F.floor((now_ms - at_ms) / (1000 * d)) for d in (60, 3600, 86400))
    return (
        F.when(at_ms.isNull(), F.lit("Never"))
        .when(seconds < 60, F.lit("Just now"))
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def sequence_number(text: Column) -> Column:
    """Decimal text without leading zeros to LONG; NULL when not a valid sequence."""
    return F.when(text.rlike(r"^(0|[1-9]\d{0,18})$"), text.try_cast("long"))


def valid_id(activity_id: Column) -> Column:
    """Ids hold 1 to 1000 characters."""
    return F.coalesce(F.length(activity_id).between(1, 1000), F.lit(False))
