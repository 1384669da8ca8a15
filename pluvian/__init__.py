"""Spark-native verification and bias correction of gridded rain forecasts."""

from pluvian.session import build_session

__all__ = ["build_session"]
