"""Explicit schemas of the tables that arrive from outside."""

from __future__ import annotations

from pyspark.sql import types as T

from weirflow import params

MESSAGE_BODY = T.StructType([
    T.StructField("schemaVersion", T.StringType()),
    T.StructField("payloadType", T.StringType()),
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("assetId", T.StringType()),
    T.StructField("siteId", T.StringType()),
    T.StructField("dmaId", T.StringType()),
    # A map, so that a new tag needs no schema change.
    T.StructField("measurements", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("quality", T.StructType([
        T.StructField("completeness", T.DoubleType()),
        T.StructField("suspect", T.BooleanType()),
    ])),
])

ENVELOPE = T.StructType([
    T.StructField("SystemProperties", T.StructType([
        T.StructField("connectionDeviceId", T.StringType()),
        T.StructField("enqueuedTime", T.TimestampType()),
    ])),
    T.StructField("body", MESSAGE_BODY),
])

KNOWLEDGE_DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("docType", T.StringType()),
    T.StructField("classification", T.StringType()),
    T.StructField("effectiveDate", T.StringType()),
    T.StructField("reviewDate", T.StringType()),
    T.StructField("owner", T.StringType()),
    T.StructField("assetClasses", T.ArrayType(T.StringType())),
    T.StructField("useCases", T.ArrayType(T.StringType())),
    T.StructField("source", T.StringType()),
    T.StructField("content", T.StringType()),
])

# Attributes of the business tables; also the vocabulary of the term resolver.
GOLD_ATTRIBUTES = {
    "Site": ["siteId", "siteName", "siteType", "region", "populationServed", "capacityMld", "criticality"],
    "Asset": ["assetId", "siteId", "assetClass", "manufacturer", "model", "ratedPowerKw", "installDate",
              "criticality", "dutyStandby"],
    "EdgeDevice": ["deviceId", "siteId", "assetId", "deviceType", "status", "runtimeVersion", "lastHeartbeatUtc",
                   "certExpiryUtc", "deploymentId"],
    "Telemetry": ["timestamp", "deviceId", "assetId", *params.TELEMETRY_TAGS, "runHours"],
    "WaterQuality": ["timestamp", "deviceId", "siteId", *params.QUALITY_PARAMETERS],
    "DmaFlow": ["timestamp", "dmaId", "inflow_m3_h", "isNightWindow"],
    "Alarm": ["alarmId", "deviceId", "severity", "state", "raisedUtc", "message"],
    "WorkOrder": ["workOrderId", "assetId", "siteId", "priority", "status", "failureMode", "estimatedHours", "createdUtc"],
    "FailureMode": ["assetClass", "failureMode", "detectableSignature", "severity", "typicalLeadTimeDays", "recommendedAction"],
    "RegulatoryLimit": ["regime", "parameter", "limitValue", "actionLevel", "citation", "jurisdiction"],
}
