"""Day arithmetic for building path lists; these lists hold one entry per day of a window."""

from datetime import date, timedelta


def shift_day(day: str, days: int) -> str:
    return (date.fromisoformat(day) + timedelta(days=days)).isoformat()


def day_list(end: str, days: int, fmt: str = "%Y-%m-%d") -> list[str]:
    """``days`` consecutive days, newest first, ending on ``end``."""
    last = date.fromisoformat(end)
    return [(last - timedelta(days=back)).strftime(fmt) for back in range(days)]
