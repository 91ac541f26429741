"""Respondex: response-quality and respondent-authenticity analytics on Spark."""

__version__ = "0.1.0"
