"""Grain-safe rental-portfolio analytics on Spark DataFrames."""

from .schema import Tables

__all__ = ["Tables"]
