"""Joins that a hot key doesn't bring to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def salted_lookup(rows: DataFrame, table: DataFrame, on: list[str], spread: Column, salts: int = 32, how: str = "left") -> DataFrame:
    """rows joined to table (one row a key, null keys too) by ``on``.

    A key and the set of its salts meet the table on the key, and the rows meet those by key and salt.  ``spread`` must
    give a row the same value whenever it is computed.
    """
    if not 1 <= salts <= 63:
        raise ValueError("salts must lie between 1 and 63, the bits of a number")
    salted = rows.withColumn("_key", F.struct(*on)).withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    keyed = table.withColumn("_key", F.struct(*on)).drop(*on)
    used = salted.groupBy("_key").agg(F.bit_or(F.expr("shiftleft(1L, _salt)")).alias("_salts"))
    each = F.filter(F.sequence(F.lit(0), F.lit(salts - 1)), lambda i: F.getbit("_salts", i) == 1)
    found = used.join(keyed, "_key").withColumn("_salt", F.explode(each)).drop("_salts")
    return salted.join(found, ["_key", "_salt"], how).drop("_key", "_salt")
