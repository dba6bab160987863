"""How the given tables play the part of the sensor fleet's tables.

Each function derives one input of the operators, row by row or by grouping, so the work grows with the tables.
The long factors keep means off exact rounding ties, which SQL engines settle differently.
``oracle_views`` states the same mappings in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow import params
from weirflow.sources.readers import read_parquet

AS_OF = "2024-01-31 00:00:00"
# The events are sparse (about two per device and day), so the flatline rule is scaled down to bite.
MIN_SAMPLES, STD_LIMIT = 3, 1.0
EXPECTED_PER_HOUR = 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with instants instead of zone-less times, and ``k`` lifted out of the JSON text."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _name(prefix: str, number: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.col(number).cast("string") if isinstance(number, str) else number.cast("string"))


def _pick(number: Column, values: list) -> Column:
    """The value at ``number`` of a short fixed list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _ids() -> list[Column]:
    return [
        _name("DEV-", "user_id").alias("deviceId"),
        _name("AST-", "user_id").alias("assetId"),
        _name("SITE-", F.col("user_id") % 25).alias("siteId"),
    ]


def _telemetry_values() -> Column:
    v, k = F.col("value"), F.col("k")
    return F.struct(
        (v * 0.1372904651).alias("vibration_mm_s"),
        (k * 2.4731957803 - 30).alias("bearing_temp_c"),
        (v * 4.0273918465).alias("motor_current_a"),
        (v * 2.0193847561 + k).alias("power_kw"),
        (k * 3.0128475693).alias("flow_m3_h"),
        (k * 0.4918273645 - 2).alias("pressure_bar"),
        F.when(F.col("event_type") != "error", v * 0.0203847561).alias("suction_pressure_bar"),
        (F.col("event_id") / 100.0).alias("runHours"),
    )


def _quality_values() -> Column:
    v, k = F.col("value"), F.col("k")
    return F.struct(
        F.when(F.col("event_type") != "error", v * 0.0493827165).alias("chlorine_mg_l"),
        (k * 0.0201938475).alias("turbidity_ntu"),
        (k * 0.0249182736 + 6).alias("ph"),
        (v * 20.0182736455).alias("conductivity_us_cm"),
        (v * 0.2518273645).alias("temperature_c"),
    )


def resend(rows: DataFrame) -> DataFrame:
    """Events as they arrive: every seventh is sent again an hour later with a corrected value."""
    resent = F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    rows = rows.withColumn("again", F.explode(resent))
    lag = F.col("k") * 10 + F.col("again") * 3600
    return rows.withColumns({
        "value": F.col("value") + F.col("again"),
        "enqueuedUtc": F.col("ts") + F.make_dt_interval(secs=lag.cast("decimal(18,6)")),
        "isReplay": lag > params.REPLAY_LAG_SECONDS,
    })


def to_bronze_rows(arrivals: DataFrame, measurements: Column) -> DataFrame:
    return arrivals.select(
        F.col("ts").alias("eventTimeUtc"),
        "enqueuedUtc",
        *_ids(),
        "isReplay",
        F.when(F.col("k") % 2 == 0, F.lit("1.1")).alias("schemaVersion"),
        measurements.alias("measurements"),
    )


def _arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resend(_events(spark, sf_dir))


def _bronze(spark: SparkSession, sf_dir: str, measurements: Column) -> DataFrame:
    return to_bronze_rows(_arrivals(spark, sf_dir), measurements)


def bronze_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze(spark, sf_dir, _telemetry_values())


def bronze_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bronze(spark, sf_dir, _quality_values())


def bronze_dma(spark: SparkSession, sf_dir: str) -> DataFrame:
    flow = F.struct((F.col("value") * 1.0183746529).alias("flow_m3_h"), (F.col("k") * 0.0492837465).alias("pressure_bar"))
    rows = _arrivals(spark, sf_dir)
    return rows.select(
        F.col("ts").alias("eventTimeUtc"),
        "enqueuedUtc",
        F.when(F.col("user_id") % 2 == 0, _name("DMA-", "user_id")).alias("dmaId"),
        _name("DMA-", "user_id").alias("siteId"),
        flow.alias("measurements"),
    )


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat trusted telemetry, one row per event."""
    v, k = F.col("value"), F.col("k")
    return _events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"),
        *_ids(),
        F.when(F.col("event_type") != "error", v * 0.1372904651).alias("vibration_mm_s"),
        (k * 1.0219384756).alias("bearing_temp_c"),
        (v * 2.0193847561).alias("power_kw"),
        (k * 3.0128475693).alias("flow_m3_h"),
    )


def water_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat water-quality readings, one row per event."""
    return _events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"),
        *_ids(),
        _quality_values().alias("q"),
    ).select("timestamp", "deviceId", "siteId", "q.*")


def dma_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"),
        _name("DMA-", "user_id").alias("dmaId"),
        (F.col("value") * 1.0183746529).alias("flow_m3_h"),
        (F.col("user_id") % 10 + 25.0).alias("baselineMnf_m3_h"),
    )


def dma_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"),
        _name("DMA-", F.col("user_id") % 10).alias("dmaId"),
        _name("SEN-", "user_id").alias("sensorId"),
        (F.col("k") * 0.0201938475 + 2).alias("pressure_bar"),
    )


def alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).filter(F.col("event_type").isin("error", "purchase"))
    state = _pick(F.col("event_id"), ["active", "acknowledged", "cleared"])
    return rows.select(
        _name("ALM-", "event_id").alias("alarmId"),
        *_ids(),
        _pick(F.col("k"), ["critical", "high", "medium", "low"]).alias("severity"),
        F.concat_ws(" ", "event_type", F.lit("alarm")).alias("title"),
        state.alias("state"),
        F.col("ts").alias("raisedAt"),
        F.when(state == "cleared", F.col("ts") + F.expr("interval 6 hours")).alias("clearedAt"),
        F.lit("rule-engine").alias("source"),
    )


def connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    lost = F.col("event_type").isin("error", "view")
    return _events(spark, sf_dir).select(
        _ids()[0],
        _ids()[2],
        F.when(lost, "disconnected").otherwise("connected").alias("event"),
        F.col("ts").alias("timestamp"),
        F.when(lost, F.col("k") * 6).alias("durationMinutes"),
        F.when(lost, _pick(F.col("k"), ["signal_loss", "tls_error", "power_cycle"])).alias("reason"),
    )


def calibrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).filter("event_type = 'view'")
    return rows.select(
        _ids()[0],
        _pick(F.col("k"), ["chlorine_mg_l", "turbidity_ntu", "ph"]).alias("parameter"),
        F.col("ts").alias("calibratedAt"),
        (F.col("value") / 1000).alias("postCalError"),
        F.when(F.col("k") < 90, "pass").otherwise("fail").alias("result"),
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").alias("n")
    r = table(spark, sf_dir, "region").alias("r")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        _name("SITE-", "n_nationkey").alias("siteId"),
        F.col("n_name").alias("siteName"),
        _pick(F.col("n_nationkey"), ["treatment", "wastewater", "pumping", "storage", "dma"]).alias("siteType"),
        F.col("r_name").alias("region"),
        (F.col("n_nationkey") * 1000).alias("populationServed"),
        (F.col("n_nationkey") * 1.5).alias("capacityMld"),
    )


def devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    status = F.create_map(*[F.lit(x) for x in (
        "MACHINERY", "offline", "BUILDING", "online", "AUTOMOBILE", "online", "HOUSEHOLD", "degraded",
        "FURNITURE", "connected")])
    return c.select(
        _name("DEV-", key).alias("deviceId"),
        _name("SITE-", "c_nationkey").alias("siteId"),
        _name("AST-", key).alias("assetId"),
        _pick(key, ["gateway", "sensor", "analyzer"]).alias("deviceType"),
        status[F.col("c_mktsegment")].alias("status"),
        F.concat(F.lit("1.4."), (key % 5).cast("string")).alias("runtimeVersion"),
        F.floor(F.col("c_acctbal") / 10).cast("int").alias("certDaysToExpiry"),
        (key % 97).alias("minutesSinceLastMessage"),
        _pick(key, ["cellular", "ethernet"]).alias("connectivity"),
        _name("DEP-", key % 10).alias("deploymentId"),
    )


def twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two desired/reported properties per device; some reports differ, some are missing on both sides."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    want = F.col("c_nationkey").cast("string")
    seen = F.when(key % 5 == 0, F.concat(want, F.lit("0"))).when(key % 5 != 1, want)
    rate = F.when(key % 4 != 0, F.lit("60"))
    props = F.array(
        F.struct(F.lit("telemetryModule").alias("moduleId"), F.lit("batchSize").alias("property"),
                 want.alias("desiredValue"), seen.alias("reportedValue")),
        F.struct(F.lit("edgeAgent").alias("moduleId"), F.lit("samplingSeconds").alias("property"),
                 rate.alias("desiredValue"), rate.alias("reportedValue")),
    )
    return c.select(_name("DEV-", key).alias("deviceId"), F.inline(props))


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    kind = F.create_map(*[F.lit(x) for x in (
        "ECONOMY", "pump", "STANDARD", "blower", "LARGE", "motor", "PROMO", "valve", "MEDIUM", "analyzer",
        "SMALL", "flowmeter")])
    return table(spark, sf_dir, "part").select(
        _name("AST-", key).alias("assetId"),
        _name("DEV-", key).alias("deviceId"),
        _name("SITE-", key % 25).alias("siteId"),
        kind[F.col("p_type")].alias("assetClass"),
        F.when(key % 5 != 4, _pick(key, ["intake", "filtration", "dosing", "pumping"])).alias("processArea"),
        F.col("p_brand").alias("manufacturer"),
        F.col("p_name").alias("model"),
        (F.col("p_size") * 2.0).alias("ratedPowerKw"),
        _pick(key, ["critical", "high", "medium", "low"]).alias("criticality"),
        _pick(key, ["duty", "standby"]).alias("dutyRole"),
        F.date_add(F.lit("2010-01-01").cast("date"), (key % 3650).cast("int")).alias("installDate"),
    )


def spares(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        _name("AST-", F.floor(key / 2)).alias("assetId"),
        _name("PN-", key).alias("partNumber"),
        F.col("p_retailprice").alias("unitCost"),
        F.when(key % 11 != 0, F.col("p_size") % 10).alias("onHand"),
        (F.col("p_size") % 7).alias("minStock"),
    )


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    created = F.col("o_orderdate").cast("timestamp")
    done = F.col("o_orderstatus") == "F"
    priority = F.create_map(*[F.lit(x) for x in (
        "1-URGENT", "P1", "2-HIGH", "P2", "3-MEDIUM", "P3", "4-NOT SPECIFIED", "P4", "5-LOW", "P4")])
    status = F.create_map(*[F.lit(x) for x in ("F", "closed", "O", "open", "P", "in_progress")])
    return table(spark, sf_dir, "orders").select(
        _name("WO-", key).alias("workOrderId"),
        _name("AST-", "o_custkey").alias("assetId"),
        _name("SITE-", F.col("o_custkey") % 25).alias("siteId"),
        priority[F.col("o_orderpriority")].alias("priority"),
        status[F.col("o_orderstatus")].alias("status"),
        F.when(key % 6 != 5, _pick(key, ["Bearing wear", "Cavitation", "Seal failure"])).alias("failureMode"),
        created.alias("createdAt"),
        F.when(done, created + F.make_dt_interval(days=(key % 14).cast("int"))).alias("completedAt"),
        ((key % 27) * 0.5).alias("downtimeHours"),
        _name("CREW-", key % 4).alias("crewId"),
        F.col("o_totalprice").alias("costUsd"),
    )


def crews(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        _name("SITE-", F.col("o_custkey") % 25).alias("siteId"),
        F.col("o_orderdate").cast("date").alias("date"),
        _pick(key, ["mechanical", "electrical", "instrumentation"]).alias("skill"),
        _name("CREW-", key).alias("crewId"),
        _pick(key, [0, 0, 4, 8, 8, 12]).alias("availableHours"),
    )


def proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Estimated jobs."""
    return table(spark, sf_dir, "lineitem").groupBy(_name("PRP-", "l_orderkey").alias("proposalId")).agg(
        F.sum(F.col("l_linenumber") * 1.0).alias("estimatedHours"),
        (F.max("l_quantity") - 10).alias("downtimeHours"),
    )


def proposal_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that the jobs need; a seventh line asks for a part that nobody stocks."""
    part = F.col("l_partkey") + F.when(F.col("l_linenumber") == 7, 1000000000).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        _name("PRP-", "l_orderkey").alias("proposalId"), _name("PN-", part).alias("partNumber")
    )


def nrw_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy(
        _name("DMA-", "l_suppkey").alias("dmaId"),
        F.trunc("l_shipdate", "month").alias("periodStart"),
    ).agg(
        F.round(F.sum(gross), 4).alias("inputM3"),
        F.round(F.sum(gross * (1 - F.col("l_discount"))), 4).alias("billedM3"),
        F.lit(0.62).alias("costPerM3"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        _name("DEP-", key).alias("deploymentId"),
        (key % 40).alias("targetedCount"),
        (key % 40).alias("appliedCount"),
        F.floor((key % 40) * 0.9).alias("reportedSuccessCount"),
    )


def pump_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy and volume per running hour of each pump, over years."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("l_orderkey") % 24).cast("int"))
         ).alias("timestamp"),
        _name("DEV-", "l_suppkey").alias("deviceId"),
        _name("SITE-", F.col("l_suppkey") % 25).alias("siteId"),
        (F.col("l_extendedprice") * 0.0103719457).alias("power_kw"),
        F.col("l_quantity").alias("flow_m3_h"),
    )


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    key = F.col("doc_id")
    return d.select(
        F.concat(F.lit("DOC-"), key.cast("string")).alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("source").alias("docType"),
        _pick(key, params.CLEARANCE).alias("classification"),
        F.date_add(F.lit("2023-01-01").cast("date"), (key % 700).cast("int")).alias("effectiveDate"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 300).cast("int")).alias("reviewDate"),
        F.when(key % 3 != 0, F.array("lang")).otherwise(F.array().cast("array<string>")).alias("assetClasses"),
        F.col("text").alias("content"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question log: each user turn, opened by one of a few phrases an operator would use."""
    phrases = QUESTION_PHRASES
    key = F.col("conv_id") + F.col("turn")
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        _name("Q-", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("questionId"),
        F.concat_ws(" ", _pick(key, phrases), F.col("text")).alias("question"),
    )


# How operators open their questions.
QUESTION_PHRASES = [
    "Why is the vibration on WTP-01-PUMP-003 climbing?",
    "Is RES-03 chlorine still compliant after 14 days?",
    "DMA-14 night flow looks high - do we have a leak?",
    "Which pump is wasting the most energy at peak tariff?",
    "WELL-09-GW-001 has stopped reporting.",
    "What does the SOP say about chlorine residual sampling?",
    "Create a work order for the pump bearing of PUMP-003 at WTP-01.",
    "I'm not receiving any data from WTP-01-GW-001.",
    "Should we issue a boil water notice?",
    "Morning briefing, please.",
    "Hello there.",
    "Please assign the ticket and change the job to P2 within 3 days.",
]


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with a user, a time and the answer's routing facts."""
    t = table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    return t.select(
        _name("CNV-", conv).alias("conversationId"),
        turn.alias("turn"),
        _name("USR-", conv % 20).alias("userId"),
        "role",
        F.col("text").alias("content"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=conv.cast("int"), mins=turn.cast("int"))
         ).alias("createdAt"),
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")
