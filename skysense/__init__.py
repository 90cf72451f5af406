"""Spark-native analytics for multi-station sensor time series."""

from skysense.series import Series

__all__ = ["Series"]
