"""Joins in which one key may have a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks that the rows of one key are dealt to.
SALTS = 64


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], spread: Column, how: str = "left") -> DataFrame:
    """``rows`` with the one row that ``facts`` has for their keys; a key's rows are dealt to SALTS tasks by ``spread``.

    Which pairs of key and salt there are is found by an aggregate before the shuffle, so a key that is rare is not copied.
    A null key has no facts.
    """
    dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    pairs = dealt.select(*keys, "__salt").distinct().join(facts, keys)
    return dealt.join(pairs, [*keys, "__salt"], how).drop("__salt")
