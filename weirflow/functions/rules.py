"""Column rules shared by the operators. All are built-in expressions and stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weirflow import params


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``.

    Optimizer rules that move expressions copy a column at each use; a chain of such columns would grow
    exponentially. The bound variable of a lambda is never copied.
    """
    return F.transform(F.array(value), body)[0]


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def outside(tag: str, low: float, high: float) -> Column:
    """True for a value outside its range, false for NULL."""
    return F.coalesce(~F.col(tag).between(low, high), F.lit(False))


def quality_flag(flat: Column, out_of_range: Column, replay: Column) -> Column:
    return (
        F.when(flat, "suspect_flatline").when(out_of_range, "suspect_range").when(replay, "replayed").otherwise("good")
    )


def is_flat(min_samples: int, std_limit: float) -> Column:
    return F.coalesce((F.col("trailingCount") >= min_samples) & (F.col("trailingStd") < std_limit), F.lit(False))


def iso_band(kw: Column) -> Column:
    return F.when(kw <= params.ISO_SMALL_KW, "small").when(kw <= params.ISO_MEDIUM_KW, "medium").otherwise("large")


def iso_zone(value: Column, ab: Column, bc: Column, cd: Column) -> Column:
    return (
        F.when(value.isNull() | ab.isNull(), "unknown")
        .when(value >= cd, "D")
        .when(value >= bc, "C")
        .when(value >= ab, "B")
        .otherwise("A")
    )


def cert_risk(days: Column) -> Column:
    return F.when(days < 0, "expired").when(days <= 7, "critical").when(days <= 30, "warning").otherwise("ok")


def tariff_period(ts: Column) -> Column:
    hours = any_of([F.hour(ts).between(*span) for span in params.PEAK_HOURS])
    return F.when(F.dayofweek(ts).between(2, 6) & hours, "peak").otherwise("offpeak")


def trend(first: Column, last: Column, tolerance: float = 0.05) -> Column:
    change = last - first
    return (
        F.when(change > F.abs(first) * tolerance, "rising")
        .when(change < -F.abs(first) * tolerance, "falling")
        .otherwise("stable")
    )


def steady(value: Column, digits: int) -> Column:
    """Round half up after shaving the last bits.

    The last bits of a distributed sum depend on the order in which tasks finish; without the inner rounding a
    value on a tie could round either way from run to run.
    """
    return F.round(F.round(value, digits + 6), digits)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Rounded percentage, NULL when the whole is zero."""
    return steady(F.try_divide(part, whole) * 100, digits)


def stable_id(*parts: Column | str, length: int = 24) -> Column:
    """The same id for the same key parts, so that a rerun updates instead of duplicating."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.substring(F.sha1(F.concat_ws("|", *cols)), 1, length)


def within(ts: str, as_of: Column, hours: float) -> Column:
    """Up to ``hours`` before ``as_of`` and not after it: rows of the future belong to a later run."""
    return (F.col(ts) >= as_of - F.make_dt_interval(secs=F.lit(float(hours) * 3600))) & (F.col(ts) <= as_of)


def canonical(column: Column) -> Column:
    """Replace other systems' spellings by ours."""
    pairs = [F.lit(x) for kv in params.CANONICAL_WORDS.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.lower(column)], column)


def equal_ignoring_case(column: Column, value: str) -> Column:
    return F.lower(column) == F.lower(F.lit(value))


def matches(criteria: dict[str, object]) -> Column:
    """Optional AND filter: NULL criteria are ignored, lists mean membership, text compares without case."""
    test = F.lit(True)
    for name, wanted in criteria.items():
        if wanted is None:
            continue
        if isinstance(wanted, (list, tuple, set)):
            test = test & F.col(name).isin(list(wanted))
        elif isinstance(wanted, str):
            test = test & equal_ignoring_case(F.col(name), wanted)
        else:
            test = test & (F.col(name) == F.lit(wanted))
    return test
