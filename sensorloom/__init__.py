"""Sensor and plant-operations analytics as composable PySpark DataFrame operators."""

from sensorloom.session import build_session, prepare

__all__ = ["build_session", "prepare"]
