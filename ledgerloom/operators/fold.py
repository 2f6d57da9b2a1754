"""The order in which rows of one day are applied."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order of actions on one day; others come last.
RANKS = {"BUY": 0, "TFR_OUT": 1, "TFR_IN": 2, "SPLIT": 3, "ROC": 4, "SELL": 5}


def intraday(action: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for p in RANKS.items() for x in p])[action], F.lit(6))
