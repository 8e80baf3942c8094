"""Lookup joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SALTS = 16


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], spread: Column, how: str = "inner",
                  salts: int = SALTS) -> DataFrame:
    """Join ``big`` to ``small`` (one row per key).  The small side is repeated once per
    salt and each big row takes one salt from ``spread``, so a hot key becomes many."""
    left = big.withColumn("_salt", F.pmod(spread, F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
