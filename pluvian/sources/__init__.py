"""Readers and writers: telemetry, forecast runs, stations, satellite, features, reports."""
