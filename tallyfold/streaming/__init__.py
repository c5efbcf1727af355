"""Streams."""

from tallyfold.streaming.aggregates import stream_agg

__all__ = ["stream_agg"]
