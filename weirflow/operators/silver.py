"""Bronze to silver: typed, deduplicated, plausibility-checked rows. Bad values are nulled and flagged, never dropped."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirflow import params
from weirflow.functions import ordered, rules


def flatten(bronze: DataFrame, tags: list[str], ids: list[str], extra: list[str] = ()) -> DataFrame:
    """Lift ``measurements`` (struct or map) to typed tag columns and fill the defaults."""
    return bronze.select(
        F.col("eventTimeUtc").cast("timestamp").alias("timestamp"),
        F.col("enqueuedUtc").cast("timestamp").alias("ingestedUtc"),
        *ids,
        F.coalesce("isReplay", F.lit(False)).alias("isReplay"),
        F.coalesce("schemaVersion", F.lit("1.0")).alias("schemaVersion"),
        *[F.col(f"measurements.{t}").cast("double").alias(t) for t in [*tags, *extra]],
    )


def lookback(df: DataFrame, ts: str, hours: float, as_of: str | None = None) -> DataFrame:
    """Rows of the last ``hours``; the moment is given or the newest event, never the wall clock.

    The partition date is filtered along, or the scan would open every folder.
    """
    now = ordered.as_of_or_max(df, ts, as_of)
    rows = df.filter(rules.within(ts, now, hours))
    if "ingestDate" in df.columns:
        rows = rows.filter(F.col("ingestDate") >= F.to_date(now - F.make_dt_interval(secs=F.lit(float(hours) * 3600))))
    return rows


def dedup_latest(df: DataFrame, keys: list[str], arrival: str = "ingestedUtc") -> DataFrame:
    """One row per key: the latest arrival wins, equal arrivals are settled by a hash of the row."""
    return ordered.latest_by(df, keys, [F.col(arrival), ordered.tie_hash(df, keys)])


def apply_bounds(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Null out-of-range values and record that there were any."""
    bad = {tag: rules.outside(tag, *limits) for tag, limits in bounds.items()}
    return df.withColumn("hadOutOfRange", rules.any_of(list(bad.values()))).withColumns(
        {tag: F.when(~test, F.col(tag)) for tag, test in bad.items()}
    )


def judge(df: DataFrame, flat: Column, flat_name: str) -> DataFrame:
    """Add the quality verdict and drop the working columns."""
    return (
        df.withColumn(flat_name, flat)
        .withColumn(
            "qualityFlag", rules.quality_flag(F.col(flat_name), F.col("hadOutOfRange"), F.col("isReplay"))
        )
        .withColumn("isTrustworthy", F.col("qualityFlag").isin("good", "replayed"))
        .withColumn("ingestDate", F.to_date("timestamp"))
        .drop("trailingCount", "trailingStd")
    )


def _cleaned(raw: DataFrame, bounds: Mapping[str, tuple[float, float]], watched: str) -> DataFrame:
    """Dedup, bounds and trailing statistics of the watched tag. Hot devices are told apart on the raw rows, so that
    every row is deduplicated once, on one of the two ways."""

    def way(bucket_seconds: int) -> Callable[[DataFrame], DataFrame]:
        def clean(rows: DataFrame) -> DataFrame:
            rows = apply_bounds(dedup_latest(rows, ["deviceId", "timestamp"]), bounds)
            return ordered.trailing_in_buckets(
                rows, ["deviceId"], "timestamp", watched, ordered.DAY, bucket_seconds
            )

        return clean

    return ordered.split_hot(raw, ["deviceId"], way(ordered.DAY), way(ordered.MINUTE))


def silver_telemetry(
    bronze: DataFrame,
    *,
    min_samples: int = params.FLATLINE_MIN_SAMPLES,
    std_limit: float = params.FLATLINE_STD,
) -> DataFrame:
    raw = flatten(bronze, params.TELEMETRY_TAGS, ["deviceId", "assetId", "siteId"], ["runHours"])
    rows = _cleaned(raw, params.TELEMETRY_BOUNDS, "vibration_mm_s")
    return judge(rows, rules.is_flat(min_samples, std_limit), "isFlatline")


def silver_water_quality(
    bronze: DataFrame,
    *,
    min_samples: int = params.FLATLINE_MIN_SAMPLES,
    std_limit: float = params.FLATLINE_STD,
) -> DataFrame:
    raw = flatten(bronze, params.QUALITY_PARAMETERS, ["deviceId", "siteId"])
    rows = _cleaned(raw, params.QUALITY_BOUNDS, "chlorine_mg_l")
    return judge(rows, rules.is_flat(min_samples, std_limit), "chlorineSensorFlatline")


def night_window(df: DataFrame, ts: str = "timestamp", hours: tuple[int, int] = (2, 3)) -> DataFrame:
    return df.withColumn("isNightWindow", F.hour(ts).between(*hours))


def flatten_dma(bronze: DataFrame) -> DataFrame:
    """Typed flow and pressure of each area; a row without an area counts for its site."""
    return bronze.select(
        F.col("eventTimeUtc").cast("timestamp").alias("timestamp"),
        F.col("enqueuedUtc").cast("timestamp").alias("ingestedUtc"),
        F.coalesce("dmaId", "siteId").alias("dmaId"),
        F.col("measurements.flow_m3_h").cast("double").alias("inflow_m3_h"),
        F.col("measurements.pressure_bar").cast("double").alias("pressure_bar"),
    )


def silver_dma_flow(bronze: DataFrame, *, night_hours: tuple[int, int] = (2, 3)) -> DataFrame:
    rows = night_window(dedup_latest(flatten_dma(bronze), ["dmaId", "timestamp"]), hours=night_hours)
    return rows.withColumn("ingestDate", F.to_date("timestamp"))


@dataclass(frozen=True)
class Ledger:
    """Hour ledger over the whole device x hour grid, so that silent hours show up as ``no_data``.

    The grid has far more rows than there are devices or samples, so it is unfolded last: :meth:`folded` has a row for each device, with the hours that it has
    samples in, :meth:`days` one for each device and day, and :meth:`hours` the ledger. Only the first needs a shuffle; whoever writes by day may deal out
    days and unfold their hours behind that.
    """

    start: Column
    end: Column
    expected_per_hour: int = params.SAMPLES_PER_HOUR
    min_pct: float = params.MIN_COMPLETENESS_PCT

    def _span(self) -> tuple[Column, Column]:
        return F.date_trunc("hour", self.start), F.date_trunc("hour", self.end)

    def _pct(self, received: Column) -> Column:
        return F.least(F.lit(100.0), rules.steady(received / F.lit(self.expected_per_hour) * 100, 1))

    def folded(self, silver: DataFrame, devices: DataFrame) -> DataFrame:
        """(deviceId, counts): the counts by hour, by day. A small table of devices is dealt out too, as each of its rows becomes a whole span of hours."""
        hour = F.date_trunc("hour", "timestamp")
        by_hour = silver.groupBy("deviceId", hour.alias("hour")).agg(
            F.count(F.lit(1)).alias("receivedSamples"),
            F.count_if("isTrustworthy").alias("trustworthySamples"),
        )
        counts = F.struct("receivedSamples", "trustworthySamples", self._pct(F.col("receivedSamples")).alias("completenessPct"))
        by_day = by_hour.filter(F.col("hour").between(*self._span())).groupBy("deviceId", F.to_date("hour").alias("day")).agg(
            F.map_from_entries(F.collect_list(F.struct("hour", counts))).alias("hours"))
        received = by_day.groupBy("deviceId").agg(F.map_from_entries(F.collect_list(F.struct("day", "hours"))).alias("counts"))
        return devices.select("deviceId").repartition("deviceId").join(received, "deviceId", "left")

    def days(self, folded: DataFrame) -> DataFrame:
        """(deviceId, ingestDate, counts): the counts by hour of that day, NULL where it has none."""
        first, last = self._span()
        every = F.explode(F.sequence(F.to_date(first), F.to_date(last), F.expr("interval 1 day")))
        return folded.select("deviceId", "counts", every.alias("ingestDate")).withColumn("counts", F.col("counts")[F.col("ingestDate")])

    def hours(self, days: DataFrame) -> DataFrame:
        first, last = self._span()
        day, hour = F.col("ingestDate"), F.expr("interval 1 hour")
        of_day = F.sequence(F.greatest(first, day.cast("timestamp")), F.least(last, F.date_add(day, 1).cast("timestamp") - hour), hour)
        rows = days.select("deviceId", "ingestDate", "counts", F.explode(of_day).alias("hour"))
        got, none = F.col("counts")[F.col("hour")], F.lit(0).cast("long")
        pct = F.coalesce(got["completenessPct"], self._pct(none))
        verdict = F.when(pct >= self.min_pct, "sufficient").when(pct > 0, "degraded").otherwise("no_data")
        return rows.select(
            "deviceId",
            "hour",
            F.coalesce(got["receivedSamples"], none).alias("receivedSamples"),
            F.coalesce(got["trustworthySamples"], none).alias("trustworthySamples"),
            F.lit(self.expected_per_hour).alias("expectedSamples"),
            pct.alias("completenessPct"),
            verdict.alias("verdict"),
            "ingestDate",
        )


def completeness(
    silver: DataFrame,
    devices: DataFrame,
    *,
    expected_per_hour: int = params.SAMPLES_PER_HOUR,
    min_pct: float = params.MIN_COMPLETENESS_PCT,
    start: Column,
    end: Column,
) -> DataFrame:
    """The hour ledger of all devices, see :class:`Ledger`."""
    ledger = Ledger(start, end, expected_per_hour, min_pct)
    return ledger.hours(ledger.days(ledger.folded(silver, devices)))
