"""Residual-correction models as Spark ML jobs."""
