"""Named plug-ins: sample filters as columns, and column selection by name, pattern or kind."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SampleFilter = Callable[..., Column]
_FILTERS: dict[str, SampleFilter] = {}


def sample_filter(name: str) -> Callable[[SampleFilter], SampleFilter]:
    """Register a filter: a function of parameters that returns a boolean column. A name is taken once."""

    def add(make: SampleFilter) -> SampleFilter:
        if name in _FILTERS:
            raise ValueError(f"the filter {name!r} exists")
        _FILTERS[name] = make
        return make

    return add


def apply_filter(frame: DataFrame, name: str, **parameters: float | str) -> DataFrame:
    """Rows that a registered filter accepts; null counts as refused, an unknown name or a non-boolean result is an error."""
    if name not in _FILTERS:
        raise KeyError(f"no filter {name!r}; known: {', '.join(sorted(_FILTERS))}")
    accepted = _FILTERS[name](**parameters)
    kind = frame.select(accepted.alias("accepted")).schema["accepted"].dataType.simpleString()
    if kind != "boolean":
        raise TypeError(f"the filter {name!r} returns {kind}, not boolean")
    return frame.where(F.coalesce(accepted, F.lit(False)))


@sample_filter("relative_range")
def _relative_range(least: float = 1.0) -> Column:
    """The bar's range in per cent of its close is above ``least``."""
    return 100 * (F.col("high") - F.col("low")) / F.col("close") > least


def drop_matching(frame: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """All columns but those that a name or a shell pattern matches."""
    return frame.select(*[c for c in frame.columns if not any(fnmatchcase(c, p) for p in patterns)])


def select_available(frame: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The known columns of a list in its order; unknown ones are warned of."""
    if missing := [c for c in columns if c not in frame.columns]:
        warnings.warn(f"columns not available: {', '.join(missing)}", stacklevel=2)
    return frame.select(*[c for c in columns if c in frame.columns])


def required_bars(warm_up: Sequence[int], horizon: int, ratio: int = 1) -> int:
    """Bars to load before a live prediction: the longest warm-up in base bars, and the horizon."""
    return max(warm_up, default=0) * ratio + horizon


def embargo(spans: Sequence[int], ratio: int, horizon: int) -> int:
    """Bars between splits that no window may bridge: the longest window span or phase, and the horizon."""
    return max(*spans, ratio - 1) + horizon if spans else ratio - 1 + horizon
