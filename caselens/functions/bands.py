"""Ratios and stock levels as readable bands."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LIMITED_FROM = 87.0  # per cent occupied


def occupancy(occupied: Column, capacity: Column) -> Column:
    """Per cent to one decimal; NULL without capacity."""
    return F.round(F.try_divide(F.lit(100.0) * occupied, capacity), 1)


def occupancy_band(rate: Column, limited_from: float = LIMITED_FROM) -> Column:
    return F.when(rate >= 100, "Full").when(rate >= limited_from, "Limited").when(rate.isNotNull(), "Available")


def stock_band(stock: Column, reorder_level: Column) -> Column:
    return F.when(stock < reorder_level, "Reorder Triggered").when(stock.isNotNull(), "Adequate Stock")
