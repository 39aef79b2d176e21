"""Small fixed tables: thresholds, topic policy, scenario weights, storage tiers.

Each is a literal of at most ten rows, so a broadcast of it has a known bound.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Scenario weights (cost, latency, throughput).
SCENARIOS = [
    ("healthcare_critical", 0.1, 0.8, 0.1),
    ("industrial_high_throughput", 0.2, 0.3, 0.5),
    ("smart_city_budget", 0.9, 0.05, 0.05),
    ("balanced", 0.33, 0.33, 0.33),
]
DEFAULT_SCENARIO = "balanced"

# Broker topic to log topic.
TOPIC_MAP = [
    ("iot/smartcity/sensors", "iot-smartcity-raw"),
    ("iot/healthcare/vitals", "iot-healthcare-raw"),
    ("iot/industrial/machines", "iot-industrial-raw"),
]
UNKNOWN_TOPIC = "iot-unknown-raw"
VALIDATED_TOPIC = "iot-validated-data"
ALERT_TOPIC = "iot-alerts-critical"
ANALYTICS_TOPIC = "iot-analytics-results"
DEAD_LETTER_TOPIC = "iot-dead-letter"

# Topic, partitions, retention days, codec, cleanup policy.
TOPIC_POLICY = [
    ("iot-raw-data", 6, 7, "gzip", "delete"),
    ("iot-smartcity-raw", 3, 7, "gzip", "delete"),
    ("iot-healthcare-raw", 3, 14, "gzip", "delete"),
    ("iot-industrial-raw", 3, 7, "gzip", "delete"),
    ("iot-validated-data", 6, 14, "snappy", "delete"),
    ("iot-alerts-critical", 3, 30, "gzip", "delete"),
    ("iot-analytics-results", 3, 30, "snappy", "compact"),
    ("iot-dead-letter", 1, 90, "gzip", "delete"),
]

# Tier id, store, label, price per GB hour, access latency ms.
TIERS = [
    (0, "Redis", "HOT", 0.10, 5.0),
    (1, "NVMe", "WARM", 0.05, 20.0),
    (2, "S3", "COLD", 0.02, 100.0),
    (3, "Glacier", "ARCHIVE", 0.005, 5000.0),
]

# Codec id, parquet codec, size ratio, decode cost ms.
CODECS = [
    (0, "uncompressed", 1.0, 0.0),
    (1, "lz4", 0.6, 10.0),
    (2, "zstd", 0.3, 50.0),
]


@dataclass(frozen=True)
class Rule:
    """Fires when ``metric`` is below ``low`` or above ``high``; a missing side is not tested."""

    metric: str
    low: float | None
    high: float | None
    label: str


# Vital-sign limits and labels.
RULES = {
    "base": [
        Rule("heart_rate", 40.0, 120.0, "Cardiac Risk"),
        Rule("spo2", 92.0, None, "Hypoxia"),
        Rule("temperature", None, 39.5, "Hyperthermia"),
        Rule("systolic_bp", 90.0, None, "Haemodynamic Shock"),
        Rule("resp_rate", None, 22.0, "Respiratory Distress"),
    ],
    "strict": [
        Rule("heart_rate", 45.0, 130.0, "Cardiac Risk"),
        Rule("spo2", 92.0, None, "Hypoxia"),
        Rule("temperature", None, 39.5, "Hyperthermia"),
        Rule("systolic_bp", 88.0, None, "Haemodynamic Shock"),
        Rule("resp_rate", None, 22.0, "Respiratory Distress"),
    ],
    "capacity": [
        Rule("heart_rate", None, 130.0, "Cardiac Risk"),
        Rule("spo2", 92.0, None, "Hypoxia"),
        Rule("temperature", None, 39.5, "Hyperthermia"),
        Rule("systolic_bp", 88.0, None, "Haemodynamic Shock"),
    ],
    "heat_45": [Rule("temperature_celsius", None, 45.0, "Heat")],
    "heat_80": [Rule("temperature_celsius", None, 80.0, "Heat Spike")],
}

# The four signs that must all hold, each as a one-sided limit.
SEPSIS_SIGNS = [
    Rule("spo2", 92.0, None, "Sepsis Risk"),
    Rule("heart_rate", None, 106.0, "Sepsis Risk"),
    Rule("temperature", None, 38.8, "Sepsis Risk"),
    Rule("resp_rate", None, 22.0, "Sepsis Risk"),
]

# Order in which one alert is chosen when several fire.
ALERT_ORDER = ["Cardiac Risk", "Sepsis Risk", "Hyperthermia", "Hypoxia", "Haemodynamic Shock"]

# Physiological limits for clamping.
CLAMPS = {
    "heart_rate": (40.0, 180.0),
    "systolic_bp": (80.0, 200.0),
    "diastolic_bp": (50.0, 120.0),
    "spo2": (85.0, 100.0),
    "temperature": (35.0, 42.0),
    "resp_rate": (8.0, 30.0),
}


def scenarios_from_yaml(path: str) -> list[tuple[str, float, float, float]]:
    """Scenario weights from a settings file that maps each name to alpha, beta and gamma."""
    import yaml

    with open(path) as file:
        named = yaml.safe_load(file)
    return [(name, float(w["alpha"]), float(w["beta"]), float(w["gamma"])) for name, w in named.items()]


def scenarios(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or SCENARIOS, "scenario string, alpha double, beta double, gamma double")


def topic_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TOPIC_MAP, "topic string, target_topic string")


def topic_policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        TOPIC_POLICY, "target_topic string, partitions int, retention_days int, codec string, cleanup string"
    )


def tiers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        TIERS, "tier_id int, store string, tier string, price double, access_ms double"
    )


def codecs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODECS, "codec_id int, codec string, size_ratio double, decode_ms double")
