"""Spark-native processing of equipment telemetry: reading, classifying, modelling and auditing it."""
