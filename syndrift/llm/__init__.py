"""Operators of a training-data pipeline: one module each, with ``queries`` binding them to the driver's tables."""
