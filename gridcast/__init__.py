"""Spark-native features, day-ahead forecasting and evaluation for energy time series."""

from gridcast.schemas import FeatureSpec
from gridcast.session import build_session

__all__ = ["FeatureSpec", "build_session"]
