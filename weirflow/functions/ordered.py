"""Ordered analytics that stay spread out when one key holds a large share of the rows.

A plain ``Window.partitionBy(key)`` puts every row of a key in one task. That is the cheapest plan for ordinary
keys; the few hot ones are told apart first and cut into time buckets (or value ranges), with only per-bucket
totals carried across.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY = 86400
HOUR = 3600
MINUTE = 60

# A key with more rows than this is cut into pieces. No more than MAX_HOT_KEYS are, so their list is always small;
# a key that is not among them holds less than one part in MAX_HOT_KEYS of all rows.
HOT_ROWS = 1_000_000
MAX_HOT_KEYS = 10_000
# Steps that a ranking over all rows is cut into.
RANK_PIECES = 1000


def time_bucket(ts: str | Column, seconds: int) -> Column:
    """Number of the time bucket; the key part that splits a hot device."""
    return F.floor(F.unix_seconds(ts) / F.lit(seconds))


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the one with the greatest order; combined map-side, so duplicates never pile up."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(pick).select(*[c if c in keys else F.col(f"_row.{c}") for c in df.columns])


def hot_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with so many rows that one task should not hold them; at most ``MAX_HOT_KEYS`` by construction."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_ROWS)
    return counts.orderBy(F.col("_n").desc(), *keys).limit(MAX_HOT_KEYS).select(*keys)


def split_hot(
    df: DataFrame, keys: Sequence[str], cold: Callable[[DataFrame], DataFrame], hot: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Ordinary keys go through ``cold`` (a window per key), hot ones through ``hot`` (cut into pieces).

    The list of hot keys is short by construction, so it may be broadcast and the rows are told apart before any
    shuffle. Without hot keys the second branch is empty, and adaptive execution drops it. NULL is a key like any other.
    """
    listed = hot_keys(df, keys)
    large = F.broadcast(listed.select(*[F.col(k).alias(f"_hot_{k}") for k in keys]))
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys))
    return cold(df.join(large, same, "left_anti")).unionByName(hot(df.join(large, same, "left_semi")))


def with_positions(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Add ``position`` (1-based, in time order) and ``seriesLength`` for each key."""

    def cold(rows: DataFrame) -> DataFrame:
        every = Window.partitionBy(*keys)
        return rows.select(
            "*",
            F.row_number().over(every.orderBy(ts, *tiebreak)).cast("long").alias("position"),
            F.count(F.lit(1)).over(every).alias("seriesLength"),
        )

    return split_hot(df, keys, cold, lambda rows: positions_in_buckets(rows, keys, ts, tiebreak))


def positions_in_buckets(
    df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = (), bucket_seconds: int = HOUR
) -> DataFrame:
    """``with_positions`` for hot keys: numbered inside time buckets, and shifted by the rows of earlier buckets."""
    rows = df.withColumn("_bucket", time_bucket(ts, bucket_seconds))
    order = Window.partitionBy(*keys).orderBy("_bucket")
    offsets = (
        rows.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_bucket",
            (F.sum("_n").over(order) - F.col("_n")).alias("_before"),
            F.sum("_n").over(Window.partitionBy(*keys)).alias("seriesLength"),
        )
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(ts, *tiebreak)
    return (
        rows.withColumn("_local", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"])
        .withColumn("position", F.col("_before") + F.col("_local"))
        .select(*df.columns, "position", "seriesLength")
    )


def trailing_stats(df: DataFrame, keys: Sequence[str], ts: str, value: str, window_seconds: int = DAY) -> DataFrame:
    """Add ``trailingCount`` and ``trailingStd`` (sample) of the trailing window, whole seconds, ends included.

    A key is cut into buckets of one window length, or of a minute when it is hot.
    """
    return split_hot(
        df,
        keys,
        lambda rows: trailing_in_buckets(rows, keys, ts, value, window_seconds, window_seconds),
        lambda rows: trailing_in_buckets(rows, keys, ts, value, window_seconds, MINUTE),
    )


def trailing_in_buckets(
    df: DataFrame, keys: Sequence[str], ts: str, value: str, window_seconds: int, bucket_seconds: int
) -> DataFrame:
    """One running sum per bucket, in which each row enters at its own second and leaves ``window_seconds`` later.

    Cost is linear in the rows, where a sliding frame would redo the whole window for every row.
    What a bucket starts with are the rows of the buckets one window back to the one before it. With buckets of a
    window's length those are just the rows that will leave in this bucket, which are here anyway; with shorter
    buckets they are summed from per-bucket totals.
    """
    if window_seconds % bucket_seconds:
        raise ValueError("the window must be a whole number of buckets")
    span = window_seconds // bucket_seconds
    bucket = time_bucket(ts, bucket_seconds)

    both = F.when(F.col(value).isNotNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    steps = df.withColumn("_leaving", F.explode(both))
    leaving = F.col("_leaving") == 1
    keep = [c for c in df.columns if c not in (*keys, value)]
    steps = steps.select(
        *keys,
        "_leaving",
        (bucket + F.col("_leaving") * span).alias("_bucket"),
        # Even steps enter, odd steps leave: a row leaves only after the last second it still counts for.
        ((F.unix_seconds(ts) + F.col("_leaving") * window_seconds) * 2 + F.col("_leaving")).alias("_step"),
        F.col(value).alias("_v"),
        *[F.when(~leaving, F.col(c)).alias(c) for c in keep],
    )
    here = Window.partitionBy(*keys, "_bucket")
    if span == 1:
        # in the order of the running sums, so that both share one sort
        whole = here.orderBy("_step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        steps = steps.withColumn("_mid", F.avg(_number("_v")).over(whole))
    else:
        middle = df.groupBy(*keys).agg(F.avg(_number(value)).alias("_mid"))
        steps = steps.join(middle, list(keys))
    # Sums of squares of large values cancel; those of their distances from a common middle don't.
    v = F.col("_v") - F.coalesce("_mid", F.lit(0.0))
    parts = {"n": F.when(v.isNotNull(), F.lit(1)), "s": v, "q": v * v}
    run = here.orderBy("_step").rangeBetween(Window.unboundedPreceding, 0)
    sums = {
        f"_{k}1": F.coalesce(F.sum(F.when(leaving, -x).otherwise(x)).over(run), F.lit(0)) for k, x in parts.items()
    }
    if span == 1:
        start = {f"_{k}0": F.coalesce(F.sum(F.when(leaving, x)).over(here), F.lit(0)) for k, x in parts.items()}
        rows = steps.select("*", *[x.alias(k) for k, x in {**sums, **start}.items()]).filter(~leaving)
    else:
        middled = df.join(middle, list(keys)).withColumn(value, F.col(value) - F.coalesce("_mid", F.lit(0.0))).drop("_mid")
        start = _sums_before(middled, keys, bucket, value, span)
        rows = steps.select("*", *[x.alias(k) for k, x in sums.items()]).filter(~leaving).join(start, [*keys, "_bucket"])

    n, s, q = (F.col(f"_{k}0") + F.col(f"_{k}1") for k in parts)
    spread = F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / (n - 1))
    return rows.select(
        *[F.col("_v").alias(c) if c == value else F.col(c) for c in df.columns],
        n.alias("trailingCount"),
        F.when(n > 1, spread).alias("trailingStd"),
    )


def _number(value: str) -> Column:
    """The value, or null where it is NaN."""
    return F.when(~F.isnan(value), F.col(value))


def _sums_before(df: DataFrame, keys: Sequence[str], bucket: Column, value: str, span: int) -> DataFrame:
    """Count, sum and sum of squares of the ``span`` buckets before each bucket: totals enter after their own bucket
    and leave ``span`` buckets later, in one running sum over the buckets."""
    totals = df.groupBy(*keys, bucket.alias("_bucket")).agg(
        F.count(value).alias("_n"), F.sum(value).alias("_s"), F.sum(F.col(value) * F.col(value)).alias("_q")
    )
    steps = totals.withColumn("_turn", F.explode(F.array(F.lit(0), F.lit(1), F.lit(-1))))
    turn = F.col("_turn")
    shift = F.when(turn == 1, 1).when(turn == -1, span + 1).otherwise(0)
    steps = steps.groupBy(*keys, (F.col("_bucket") + shift).alias("_bucket")).agg(
        *[F.sum(F.col(c) * turn).alias(c) for c in ("_n", "_s", "_q")], F.bool_or(turn == 0).alias("_own")
    )
    run = Window.partitionBy(*keys).orderBy("_bucket")
    sums = [F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"{c}0") for c in ("_n", "_s", "_q")]
    return steps.select(*keys, "_bucket", "_own", *sums).filter("_own").drop("_own")


def value_at_rank(
    df: DataFrame, keys: Sequence[str], value: str, rank: Column, share: float, accuracy: int = 10000
) -> DataFrame:
    """Exact value at ``rank`` (an expression over the group size ``n``, near ``share * n``) per key."""

    def cold(rows: DataFrame) -> DataFrame:
        every = Window.partitionBy(*keys)
        rows = rows.withColumn("_at", F.row_number().over(every.orderBy(value)))
        rows = rows.withColumn("n", F.count(F.lit(1)).over(every))
        return rows.filter(F.col("_at") == rank.cast("long")).select(*keys, F.col(value).alias("rankValue"))

    def hot(rows: DataFrame) -> DataFrame:
        return rank_by_bracket(rows, keys, value, rank, share, accuracy)

    return split_hot(df.select(*keys, value).filter(F.col(value).isNotNull()), keys, cold, hot)


def rank_by_bracket(
    df: DataFrame, keys: Sequence[str], value: str, rank: Column, share: float, accuracy: int = 10000
) -> DataFrame:
    """``value_at_rank`` for hot keys. A mergeable sketch brackets the rank; only rows inside the bracket are ordered, after counting equal values
    together, so the ordering sees about 4/accuracy of a large group."""
    margin = 2.0 / accuracy
    probe = df.groupBy(*keys).agg(
        F.count(value).alias("n"),
        F.min(value).alias("_min"),
        F.max(value).alias("_max"),
        F.percentile_approx(value, [max(share - margin, 0.0), min(share + margin, 1.0)], accuracy).alias("_cut"),
    )
    small = F.col("n") <= accuracy
    bracket = probe.select(
        *keys,
        rank.cast("long").alias("_rank"),
        F.when(small, F.col("_min")).otherwise(F.col("_cut")[0]).alias("_low"),
        F.when(small, F.col("_max")).otherwise(F.col("_cut")[1]).alias("_high"),
    )
    counted = (
        df.join(F.broadcast(bracket), list(keys))  # hot keys only: at most MAX_HOT_KEYS rows
        .filter(F.col(value) <= F.col("_high"))
        .groupBy(*keys, "_rank", F.when(F.col(value) >= F.col("_low"), F.col(value)).alias("_value"))
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    order = Window.partitionBy(*keys).orderBy(F.col("_value").asc_nulls_first())
    return (
        counted.withColumn("_upto", F.sum("_count").over(order))
        .filter((F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_count") < F.col("_rank")))
        .select(*keys, F.col("_value").alias("rankValue"))
    )


def with_rank(df: DataFrame, keys: Sequence[str], by: str, name: str = "rank") -> DataFrame:
    """Add the SQL ``rank`` of each row within its key, greatest ``by`` first.

    Meant for rounded figures: rows are counted per distinct value before they are ordered, so the ordering sees
    one row per value and not one per row, and the ranks are joined back by value. Without keys the values are cut at
    quantiles of a mergeable sketch into ``RANK_PIECES`` pieces of about as many distinct values each, wherever they lie, so that no task orders them all.
    """
    counts = df.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_n"))
    if keys:
        upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy(F.col(by).desc()))
    else:
        counts = with_piece(counts, by)
        pieces = counts.groupBy("_piece").agg(F.sum("_n").alias("_all"))  # RANK_PIECES + 2 rows at most
        before = F.sum("_all").over(Window.orderBy("_piece")) - F.col("_all")
        counts = counts.join(pieces.select("_piece", before.alias("_before")), "_piece")
        upto = F.col("_before") + F.sum("_n").over(Window.partitionBy("_piece").orderBy(F.col(by).desc()))
    mine = {k: f"_rank_{k}" for k in (*keys, by)}
    ranks = counts.select(
        *[F.col(k).alias(v) for k, v in mine.items()], (upto - F.col("_n") + 1).alias(name)
    )
    same = [F.col(k).eqNullSafe(F.col(v)) for k, v in mine.items()]
    return df.join(ranks, same).drop(*mine.values())


def with_piece(values: DataFrame, by: str) -> DataFrame:
    """Add ``_piece`` to distinct ``values``, from the greatest: NaN, the stretches between quantiles, NULL."""
    number = F.col(by).cast("double")
    shares = [i / RANK_PIECES for i in range(1, RANK_PIECES)]
    cuts = values.agg(F.percentile_approx(F.when(~F.isnan(number), number), shares, 10 * RANK_PIECES).alias("cuts"))
    cuts = cuts.select(F.coalesce(F.reverse(F.array_sort(F.array_distinct("cuts"))), F.array().cast("array<double>"))).scalar()
    # how many cuts lie above the value, by bisection
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(RANK_PIECES.bit_length()))])
    above = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.get("_cuts", n + step - 1) > number, n + step).otherwise(n))
    piece = F.when(F.col(by).isNull(), RANK_PIECES + 1).when(F.isnan(number), 0).otherwise(above + 1)
    return values.withColumn("_cuts", cuts).withColumn("_piece", piece).drop("_cuts")


def tie_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """Hash of the columns besides the keys, to settle ties the same way on every run."""
    cells = []
    for field in df.schema.fields:
        if field.name not in keys:
            cell = F.col(field.name)
            # Maps cannot be hashed: their entries have no order of their own.
            cells.append(F.sort_array(F.map_entries(cell)) if isinstance(field.dataType, T.MapType) else cell)
    return F.xxhash64(*cells) if cells else F.lit(0)


def newest_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per key; Catalyst limits each task's groups before the shuffle (n up to 1000)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= n).drop("_rn")


def as_of_or_max(df: DataFrame, ts: str, as_of: str | None) -> Column:
    """The given moment, or the newest event time as a scalar subquery."""
    if as_of is not None:
        return F.lit(as_of).cast("timestamp")
    return df.agg(F.max(ts)).scalar()
