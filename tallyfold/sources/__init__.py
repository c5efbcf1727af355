"""Inputs and outputs at the edge of Spark."""
