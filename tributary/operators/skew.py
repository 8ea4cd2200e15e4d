"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt to.
WAYS = 8


def salted(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", ways: int = WAYS) -> DataFrame:
    """The join of ``big`` with ``small``, whose keys are distinct; the rows of one key of ``big`` go to ``ways`` tasks.

    ``small`` is sent ``ways`` times, so it must be the side of few rows. Rows are dealt by their other columns; where
    there are none, the join is a plain one.
    """
    salt, others = "__salt", [F.col(c) for c in big.columns if c not in keys]
    if not others:
        return big.join(small, keys, how)
    deal = F.pmod(F.xxhash64(*others), F.lit(ways)).cast("int")
    copies = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(ways - 1))))
    return big.withColumn(salt, deal).join(copies, [*keys, salt], how).drop(salt)
