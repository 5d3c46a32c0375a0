"""Ranks of ordered lists."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def rank_of(keys: list[str], *order: Column) -> Column:
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
