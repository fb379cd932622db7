"""Bounds: cut points between keys, as structs that sort in their order.

A bound is one of BeforeAll, Before(k), After(k), AfterPrefix(k) and AfterAll.
Two bounds can hold the same keys and yet differ, so order and equality use the
whole struct while key filters use ``cut`` alone. Keys are upper-case hex.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .revisions import successor


def successor_hex(prefix: str) -> str | None:
    return successor(prefix)


def succ(key: Column) -> Column:
    """The smallest key above all with this prefix, in hex; null if there is none.

    Trailing FF bytes go, the last byte goes up by one.
    """
    # whole bytes only: in "0FFF" the first byte ends with F and stays
    short = F.regexp_extract(key, r"^((?:[0-9A-F]{2})*?)(?:FF)*$", 1)
    last = F.conv(F.substring(short, -2, 2), 16, 10).cast("int") + 1
    return F.when(F.length(short) > 0, F.concat(F.substr(short, F.lit(1), F.length(short) - 2), F.lpad(F.hex(last), 2, "0")))


def bound(kind: Column, key: Column) -> Column:
    """The struct of a bound."""
    after = F.when(succ(key).isNotNull(), succ(key))
    prefix = kind == "AfterPrefix"
    length = (F.length(key) / 2).cast("int")
    return F.struct(
        F.when((kind == "AfterAll") | (prefix & after.isNull()), 1).otherwise(0).alias("is_inf"),
        F.when(kind == "Before", key).when(kind == "After", F.concat(key, F.lit("00"))).when(prefix & after.isNotNull(), after).otherwise(F.lit("")).alias("cut"),
        F.when(kind == "BeforeAll", -1).when(kind.isin("Before", "AfterAll"), 1).otherwise(0).alias("rank"),
        F.when(prefix, -length).otherwise(0).alias("neg_len"),
    )


def holds(lower: Column, upper: Column, key: Column) -> Column:
    """Whether a key is between two bounds."""
    return (lower["is_inf"] == 0) & (key >= lower["cut"]) & ((upper["is_inf"] == 1) | ((upper["rank"] != -1) & (key < upper["cut"])))


def key_place(key: Column) -> Column:
    """A key among bounds: after Before(k), before After(k)."""
    return F.struct(F.lit(0).alias("is_inf"), key.alias("cut"), F.lit(2).alias("rank"), F.lit(0).alias("neg_len"))
