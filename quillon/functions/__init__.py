"""Finance window functions as Columns."""

from .rolling import ema, ema_depth, rolling_std, sma, with_ema

__all__ = ["ema", "ema_depth", "rolling_std", "sma", "with_ema"]
