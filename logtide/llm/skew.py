"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that many rows share are joined by broadcast: those with over ``HOT`` rows and over a ``HOT_KEYS``-th of all, so no more than ``HOT_KEYS``.
HOT, HOT_KEYS = 1000, 20_000
#: Rows in all up to which a join is an ordinary one, as no key can be large.
SMALL = 100_000


def met_by(rows: DataFrame, facts: DataFrame, on: list[str], many: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``facts``, a row for each key; ``many`` is the number of rows of the key among ``total``.

    Keys that very many rows share go by broadcast: their numbers add up to ``total`` at most, so they are few.
    """
    if total <= SMALL:
        return rows.join(facts, on)
    most = max(HOT, total // HOT_KEYS)
    hot, cold = F.broadcast(facts.where(F.col(many) > most)), facts.where(F.col(many) <= most)
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on))
