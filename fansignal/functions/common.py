"""Small Column helpers shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed6(c: Column | str) -> Column:
    """Round a double to 6 places through a decimal, so the result does not depend
    on summation order (identical in Spark and in SQL engines)."""
    return fixed(c, 6)


def fixed(c: Column | str, places: int) -> Column:
    """``fixed6`` to any number of places. A double beyond the decimal (1e26 and more, infinity)
    has no digits to round and stays as it is."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.round(c.try_cast("decimal(38,12)"), places).cast("double"), c.cast("double"))


def safe_div(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den, or ``default`` when den is 0 or NULL."""
    out = F.when((den.isNull()) | (den == 0), F.lit(default)).otherwise(num / den)
    return out.cast("double")


def ltz(c: Column | str) -> Column:
    """timestamp_ntz -> timestamp (session zone is UTC) for epoch arithmetic."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("timestamp")


def epoch_seconds(c: Column | str) -> Column:
    """Seconds since epoch as double (micro precision) of a ts / ts_ntz column."""
    return F.unix_micros(ltz(c)) / F.lit(1e6)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a Column -> Column function).

    Referencing a long expression several times inlines it several times; binding it to
    a lambda variable keeps one evaluation and keeps generated code small."""
    return F.element_at(F.transform(F.array(value), body), 1)
