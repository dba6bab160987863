"""Words the text rules know: specialists and their triggers, hard rules, ontology entities. All fixed values."""

from __future__ import annotations

# Specialist, trigger words and phrases, ontology words. Order settles ties.
SPECIALISTS = [
    ("asset-health",
     ["vibration", "bearing", "pump", "motor", "blower", "failure", "predict", "rul", "remaining useful life", "overhaul",
      "cavitation", "misalign", "degradation", "condition", "maintenance due", "vfd", "impeller", "seal"],
     ["device", "asset", "pump", "motor", "telemetry"]),
    ("water-quality",
     ["chlorine", "residual", "turbidity", "ph", "coliform", "compliance", "mcl", "regulatory", "sdwa", "dwi", "epa",
      "disinfect", "thm", "dbp", "water quality", "sample", "nitrification", "analyser", "analyzer"],
     ["waterquality", "sample", "site"]),
    ("leak-detection",
     ["leak", "burst", "nrw", "non-revenue", "night flow", "mnf", "dma", "pressure transient", "water loss", "acoustic",
      "correlator", "water balance", "unaccounted", "main break"],
     ["leak", "dma", "site", "telemetry"]),
    ("energy-optimizer",
     ["energy", "kwh", "power", "tariff", "efficiency", "specific energy", "carbon", "co2", "cost", "pump schedule",
      "peak demand", "off-peak", "bep", "duty point", "optimisation", "optimization", "savings"],
     ["energy", "device", "site", "telemetry"]),
    ("fleet-operations",
     ["gateway", "edge device", "offline", "connectivity", "module", "firmware", "twin", "deployment", "ota", "drift",
      "certificate", "heartbeat", "telemetry gap", "modbus", "opc ua", "dnp3", "mqtt", "rtu", "backhaul",
      "store and forward", "fleet", "rollout", "patch"],
     ["device", "site"]),
    ("knowledge-navigator",
     ["procedure", "sop", "how do i", "manual", "standard", "policy", "regulation", "what does the", "documentation",
      "runbook", "guideline", "permit", "loto", "lockout", "specification", "warranty"],
     []),
    ("maintenance-planner",
     ["work order", "schedule", "dispatch", "crew", "technician", "plan", "job card", "raise a ticket",
      "maintenance window", "assign", "parts", "spares", "permit", "book", "arrange"],
     ["workorder", "device", "asset"]),
]

# Patterns that always involve a specialist.
HARD_RULES = [
    (r"\b(no|missing|lost|stopped|not)\s+(\w+\s+){0,2}"
     r"(data|telemetry|readings?|signal|reporting|responding|communicating)\b", "fleet-operations"),
    (r"\b(offline|unreachable|not reporting|stopped reporting|disconnected|dropped off|went dark|flat ?lin\w*|"
     r"no heartbeat)\b", "fleet-operations"),
    (r"\b(raise|create|open|log|issue)\s+(a\s+|an\s+)?(work\s?order|ticket|job|wo)\b", "maintenance-planner"),
    (r"\b(boil water|public notice|tier 1|acute|do not drink)\b", "water-quality"),
    (r"\b(sop|procedure|how do i|step[- ]by[- ]step|runbook|work instruction)\b", "knowledge-navigator"),
    (r"\b(certificat\w*|certs?)\b.*\b(expir\w*|renew\w*|rotat\w*)\b", "fleet-operations"),
    (r"\b(module twin|twin drift|deployment manifest|config drift)\b", "fleet-operations"),
]

# Estate-wide questions and who answers them.
BRIEFING = (r"\b(briefing|morning report|shift handover|estate|whole (fleet|network|system)|overall status|"
            r"status overview|what needs my attention|summary of everything)\b")
BRIEFING_SPECIALISTS = ["fleet-operations", "asset-health", "water-quality", "leak-detection", "energy-optimizer"]

# Gated actions of the maintenance planner and the words that imply them.
GATED_SPECIALIST = "maintenance-planner"
GATED_ACTIONS = [
    ("create_work_order", ["create", "raise", "open", "log", "issue", "book", "schedule"]),
    ("update_work_order", ["update", "change", "modify", "amend", "reprioriti"]),
    ("assign_work_order", ["assign", "allocate", "dispatch"]),
]

# Id patterns.
DEVICE_ID = r"\b([A-Z]{2,4}-\d{1,3}-[A-Z0-9]{2,6}-\d{1,3})\b"
SITE_ID = r"\b((?:WTP|WWTP|PS|RES|DMA|WELL)-\d{1,3})\b"
SHORT_ID = r"\b([A-Z]{2,6}-\d{1,3})\b"
SITE_PREFIXES = ["WTP", "WWTP", "PS-", "RES", "DMA", "WELL"]

# Words that carry no meaning in a search.
STOP_WORDS = [
    "the", "and", "for", "what", "which", "who", "why", "how", "when", "where", "are", "was", "were", "with", "that", "this", "there", "their",
    "from", "into", "about", "any", "all", "has", "have", "had", "can", "could", "should", "would", "will", "does", "did", "our", "you", "your",
    "its", "not", "but", "yet", "been", "being", "next", "last", "days", "day", "hours", "week", "today", "now", "show", "tell", "give", "list",
    "please", "is", "of", "in", "on", "a", "an", "to", "me", "my", "we", "us", "it", "be", "do",
]

# Ontology entity, its synonyms, and the allowed values of its attributes.
ENTITIES = [
    ("Site", ["site", "facility", "plant", "works", "location", "station", "installation"],
     ["treatment", "wastewater", "pumping", "reservoir", "dma", "wellfield", "critical", "high", "medium", "low"]),
    ("Asset", ["asset", "equipment", "machine", "plant item", "kit", "unit"],
     ["pump", "blower", "motor", "valve", "analyser", "prv", "flowmeter", "duty", "standby", "assist"]),
    ("EdgeDevice", ["device", "gateway", "edge device", "edge node", "iot device", "plc gateway", "rtu"],
     ["sensor", "meter", "connected", "disconnected", "degraded"]),
    ("Telemetry", ["telemetry", "readings", "measurements", "sensor data", "signals", "historian", "tags"], []),
    ("WaterQuality", ["water quality", "quality", "wq", "compliance readings", "analyser readings", "chemistry"], []),
    ("DmaFlow", ["dma flow", "district flow", "night flow", "mnf", "zone flow", "inlet flow"], []),
    ("Alarm", ["alarm", "alert", "event", "trip", "exception", "fault"], ["active", "acknowledged", "cleared"]),
    ("WorkOrder", ["work order", "wo", "job", "ticket", "maintenance job", "task", "job card"],
     ["p1", "p2", "p3", "p4", "open", "assigned", "in_progress", "complete", "cancelled"]),
    ("FailureMode", ["failure mode", "fmea", "fault mode", "failure library", "degradation mode"], []),
    ("RegulatoryLimit", ["limit", "regulation", "standard", "compliance limit", "threshold", "statutory limit"],
     ["us-epa", "uk-dwi", "who"]),
]

# What attributes of the entities are also called.
ATTRIBUTE_SYNONYMS = {
    "Site": {
        "siteId": ["site id", "site code", "facility id"],
        "siteName": ["site name", "facility name"],
        "siteType": ["type", "category", "kind"],
        "region": ["area", "zone", "district", "operating region"],
        "populationServed": ["population", "customers served", "people served"],
        "capacityMld": ["capacity", "design flow", "throughput"],
        "criticality": ["importance", "criticality tier", "business criticality"],
    },
    "Asset": {
        "assetId": ["asset id", "tag", "equipment number", "asset tag"],
        "assetClass": ["class", "asset type", "equipment type"],
        "manufacturer": ["make", "vendor", "oem"],
        "model": ["model number", "part model"],
        "ratedPowerKw": ["rated power", "kw", "nameplate power", "motor size"],
        "installDate": ["installed", "commissioned", "commissioning date"],
        "criticality": ["asset criticality", "importance"],
        "dutyStandby": ["duty", "standby", "role", "run configuration"],
    },
    "EdgeDevice": {
        "deviceId": ["device id", "device name", "gateway id"],
        "deviceType": ["type", "device class"],
        "status": ["connection status", "online", "offline", "connectivity"],
        "runtimeVersion": ["iot edge version", "runtime", "agent version"],
        "lastHeartbeatUtc": ["last seen", "last contact", "last heartbeat", "last reported"],
        "certExpiryUtc": ["certificate expiry", "cert expiry", "identity expiry"],
        "deploymentId": ["manifest", "deployment", "module deployment"],
    },
    "Telemetry": {
        "timestamp": ["time", "when", "datetime", "hour"],
        "vibration_mm_s": ["vibration", "vibes", "velocity", "shake", "rms"],
        "bearing_temp_c": ["bearing temperature", "temp", "bearing temp", "heat"],
        "motor_current_a": ["current", "amps", "motor current", "load current"],
        "power_kw": ["power", "load", "kw", "demand", "consumption"],
        "flow_m3_h": ["flow", "flowrate", "throughput", "discharge"],
        "pressure_bar": ["pressure", "head", "psi"],
        "suction_pressure_bar": ["suction pressure", "inlet pressure", "npsh"],
        "runHours": ["run hours", "running hours", "operating hours", "hours run"],
    },
    "WaterQuality": {
        "chlorine_mg_l": ["chlorine", "free chlorine", "residual", "cl2", "disinfectant"],
        "turbidity_ntu": ["turbidity", "cloudiness", "ntu", "clarity"],
        "ph": ["ph", "acidity", "alkalinity"],
        "conductivity_us_cm": ["conductivity", "ec", "tds"],
        "temperature_c": ["water temperature", "temp"],
    },
    "DmaFlow": {
        "dmaId": ["dma", "district", "zone"],
        "inflow_m3_h": ["inflow", "inlet flow", "supply flow"],
        "isNightWindow": ["night", "night window", "mnf window"],
    },
    "Alarm": {
        "severity": ["severity", "priority", "urgency"],
        "state": ["status", "state", "acknowledged", "cleared"],
        "raisedUtc": ["raised", "triggered", "started", "when it fired"],
        "message": ["description", "text", "reason"],
    },
    "WorkOrder": {
        "workOrderId": ["wo number", "work order id", "job number"],
        "priority": ["priority", "urgency", "p code"],
        "status": ["status", "state", "progress"],
        "failureMode": ["failure mode", "fault", "problem", "cause"],
        "estimatedHours": ["estimate", "duration", "labour hours"],
        "createdUtc": ["raised", "created", "opened"],
    },
    "FailureMode": {
        "failureMode": ["mode", "fault type"],
        "detectableSignature": ["signature", "symptom", "indicator", "evidence"],
        "typicalLeadTimeDays": ["lead time", "warning time", "p-f interval"],
        "recommendedAction": ["action", "remedy", "fix", "intervention"],
    },
    "RegulatoryLimit": {
        "regime": ["regime", "regulator", "jurisdiction", "standard body"],
        "parameter": ["parameter", "determinand", "analyte"],
        "limitValue": ["limit", "mcl", "pcv", "guideline value", "max"],
        "actionLevel": ["action level", "trigger", "internal limit", "alert level"],
        "citation": ["citation", "reference", "regulation number"],
    },
}

# Relationships between entities (child, child key, parent, parent key).
RELATIONSHIPS = [
    ("Asset", "siteId", "Site", "siteId"),
    ("EdgeDevice", "siteId", "Site", "siteId"),
    ("EdgeDevice", "assetId", "Asset", "assetId"),
    ("Telemetry", "deviceId", "EdgeDevice", "deviceId"),
    ("WaterQuality", "deviceId", "EdgeDevice", "deviceId"),
    ("Alarm", "deviceId", "EdgeDevice", "deviceId"),
    ("WorkOrder", "assetId", "Asset", "assetId"),
    ("WorkOrder", "failureMode", "FailureMode", "failureMode"),
    ("FailureMode", "assetClass", "Asset", "assetClass"),
]
