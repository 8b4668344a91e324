"""Operators over DataFrames, each usable without the registered queries."""
