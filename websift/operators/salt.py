"""Joins whose big side has hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 32

# Ids that may be sent to every executor: 4 MB of numbers.
BROADCAST_IDS = 500_000


def small_join(big: DataFrame, few: DataFrame, on: str, at_most: int | None) -> DataFrame:
    """Inner join of a wide table with the rows picked from it by a number.

    ``at_most`` bounds the rows of ``few``, if the caller knows a bound. Within ``BROADCAST_IDS`` their ids alone go to every executor
    and ``big`` is only scanned; its text would else be shuffled for a few rows. What ``few`` carries is joined to the picked rows.
    """
    if at_most is not None and at_most <= BROADCAST_IDS:
        big = big.join(F.broadcast(few.select(on).distinct()), on, "left_semi")
    return big.join(few, on)


def salted_join(big: DataFrame, small: DataFrame, on: list[str], spread_by: str,
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Join where one key may hold a large share of ``big``.

    Rows of ``big`` are dealt over ``salts`` by ``spread_by``; each row of ``small`` is there for every
    salt. ``how`` must keep the ``big`` side whole at most (inner, left, left_semi, left_anti). No side is
    broadcast by force: Spark does so by itself when the measured size is small.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")
