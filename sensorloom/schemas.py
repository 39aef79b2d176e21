"""Message schemas as DDL text. Field names are the wire format."""

from __future__ import annotations

# Wire format of the device messages.
SMART_CITY = """
  sensor_id string, sensor_type string, city string, timestamp string,
  location struct<latitude: double, longitude: double>,
  metrics struct<
    vehicle_count: int, average_speed_kmh: double, congestion_level: string,
    lane_occupancy_percent: double, aqi: int, pm25: double, pm10: double, co2_ppm: int,
    temperature_celsius: double, humidity_percent: double,
    total_spots: int, occupied_spots: int, available_spots: int, occupancy_rate: double>
"""

VITAL_SIGNS = """
  patient_id string, device_id string, device_type string, hospital string, timestamp string,
  vitals struct<
    heart_rate_bpm: int, blood_pressure: struct<systolic: int, diastolic: int>,
    oxygen_saturation_percent: double, temperature_celsius: double, respiratory_rate_bpm: int>,
  alert_level string, battery_percent int
"""

ECG = """
  patient_id string, device_id string, device_type string, hospital string, timestamp string,
  ecg_data struct<
    sample_rate_hz: int, lead: string, waveform: array<double>, heart_rate_bpm: int,
    qrs_duration_ms: int, qt_interval_ms: int>
"""

MACHINE = """
  machine_id string, machine_type string, factory string, timestamp string,
  sensors struct<
    vibration_mms: double, temperature_celsius: double, pressure_bar: double,
    power_consumption_kw: double, rotation_speed_rpm: int, acoustic_db: double>,
  status struct<
    operational: boolean, wear_level: double, alert_level: string,
    estimated_remaining_life_hours: int, cycles_completed: int>
"""

PRODUCTION = """
  machine_id string, machine_type string, factory string, timestamp string,
  production struct<
    units_produced_hour: int, efficiency_percent: double, defect_rate_percent: double,
    downtime_minutes: int, quality_score: double>
"""

FLAT_READING = "sensor_id string, sensor_type string, value double, timestamp string, location string"

WARD_READING = """
  patient_id string, ward string, heart_rate double, spo2 double, temperature double,
  systolic_bp double, resp_rate double, timestamp string
"""

# What every message kind may say about its sender.
IDENTITY = """
  sensor_id string, device_id string, machine_id string, patient_id string,
  sensor_type string, device_type string, machine_type string, timestamp string
"""

# The same with the payload blocks, read as open maps so that no unknown metric is lost.
ANY_MESSAGE = f"""
  {IDENTITY.strip()},
  metrics map<string,string>, vitals map<string,string>, sensors map<string,string>
"""

EDGE_SIGNAL = "patient_id string, ts timestamp, predicted_load double, burst_alarm boolean"

ENVELOPE = "topic string, partition int, key string, value string, timestamp timestamp, offset bigint"

TRAFFIC_SAMPLE = "timestamp double, workload_rate double, kafka_lag int, cpu_util double, latency_ms double"

BATCH_METRICS = """
  query_id string, batch_id bigint, message_count bigint, elapsed_ms bigint,
  throughput double, input_rate double, state_rows bigint, late_rows bigint, finished_at timestamp
"""

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
