"""Bounded tables fed by streams, and functions that keep state across batches."""

from .feed import continuous_sma, feed_stream, poll_arrow
from .ring import Ring, ring_snapshot
from .stateful import stateful_ema

__all__ = ["Ring", "continuous_sma", "feed_stream", "poll_arrow", "ring_snapshot", "stateful_ema"]
