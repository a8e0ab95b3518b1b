"""Evaluation analytics on Spark: prompts, answer extraction, scoring, aggregation, decontamination."""

__version__ = "0.1.0"
