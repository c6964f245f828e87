"""Maps from pairs that may repeat a key: the last pair wins, as when an object is filled in order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_last_wins(entries: Column) -> Column:
    """array<struct<key, value>> -> map in which a repeated key keeps its last value.

    ``map_from_entries`` fails the whole job on the first repeated key.
    """
    return F.map_from_entries(F.filter(entries, lambda e, i: ~F.exists(
        F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda o: o["key"] == e["key"])))
