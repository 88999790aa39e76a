"""Behaviour profiles and anomaly detection for software agents on Spark."""
