"""Sensor-journal risk analytics expressed as Spark DataFrame operators."""

from undercroft.config import RiskConfig, default_config

__all__ = ["RiskConfig", "default_config"]
