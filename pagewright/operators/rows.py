"""Arrays to rows, and the order of entry ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_array(df: DataFrame, keep: list, array: Column, pos: str, name: str) -> DataFrame:
    """One row per element with its position.

    A plain explode makes the optimizer add a filter on the array's size below it, which evaluates a computed
    array once more. The outer form does not; rows of empty arrays are dropped afterwards by position.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())


def entry_order(entry_id) -> Column:
    """Orders entry ids by number: ``milliseconds-sequence``, ``partition-offset`` or plain numbers.

    Ids of another form come first, among themselves as text.
    """
    text = (F.col(entry_id) if isinstance(entry_id, str) else entry_id).cast("string")
    second = F.when(F.contains(text, F.lit("-")), F.substring_index(text, "-", -1))
    return F.struct(F.substring_index(text, "-", 1).try_cast("long").alias("major"), F.coalesce(second.try_cast("long"), F.lit(0)).alias("minor"), text.alias("id"))
