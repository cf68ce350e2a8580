"""Operators for preparing training text, each with a thin query over the driver's tables."""
