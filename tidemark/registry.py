"""The feature registry: names, types, freshness limits and defaults of all served features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400


@dataclass(frozen=True)
class Feature:
    name: str
    source: str  # batch or stream
    dtype: str = "double"
    sla_seconds: int = DAY
    default: Any = field(default=None, compare=False)


class Registry:
    """An ordered list of features with unique names."""

    def __init__(self, features: list[Feature]):
        self._by_name: dict[str, Feature] = {}
        for f in features:
            if f.name in self._by_name:
                raise ValueError(f"feature {f.name!r} is registered twice")
            self._by_name[f.name] = f

    def __iter__(self) -> Iterator[Feature]:
        return iter(self._by_name.values())

    def __len__(self) -> int:
        return len(self._by_name)

    def __getitem__(self, name: str) -> Feature:
        return self._by_name[name]

    def of(self, source: str) -> list[Feature]:
        return [f for f in self if f.source == source]

    def columns(self, source: str) -> list[Column]:
        """The source's columns, each with its freshness limit as metadata."""
        return [F.col(f.name).alias(f.name, metadata={"sla_seconds": f.sla_seconds}) for f in self.of(source)]


# The served features.
REGISTRY = Registry(
    [
        Feature("avg_bookings_90d", "batch"),
        *[Feature(f"seasonality_{d}", "batch") for d in ("mon", "tue", "wed", "thu", "fri", "sat", "sun")],
        Feature("lead_time_p50", "batch"),
        Feature("lead_time_p90", "batch"),
        Feature("cancellation_rate_180d", "batch", default=0.0),
        Feature("elasticity_estimate", "batch"),
        Feature("searches_5m", "stream", sla_seconds=300, default=0.0),
        Feature("bookings_15m", "stream", sla_seconds=900, default=0.0),
        Feature("look_to_book_1h", "stream", sla_seconds=3600, default=0.0),
        Feature("weather_temp_c", "stream", sla_seconds=3600),
        Feature("weather_precip_mm", "stream", sla_seconds=3600, default=0.0),
        Feature("weather_condition", "stream", dtype="string", sla_seconds=3600),
    ]
)


def registered(df: DataFrame, source: str, keys: list[str]) -> DataFrame:
    """`df` with its keys and the registered columns of a source, in the registry's order."""
    return df.select(*keys, *REGISTRY.columns(source))
