"""Bit vectors in BIGINT columns (bit i is coordinate i) and '0'/'1' strings (character i is coordinate i)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def weight(x) -> Column:
    return F.bit_count(col(x)).cast("int")


def parity(x, mask: int | Column) -> Column:
    """GF(2) inner product."""
    return (F.bit_count(col(x).bitwiseAND(F.lit(mask) if isinstance(mask, int) else mask)) % 2).cast("int")


def syndrome(x, masks: list[int]) -> Column:
    """Bit i is the parity with mask i; one expression, so it stays in generated code."""
    terms = [F.shiftleft(parity(x, m).cast("long"), i) for i, m in enumerate(masks)]
    return reduce(lambda a, b: a.bitwiseOR(b), terms)


def encode(x, width: int) -> Column:
    return F.reverse(F.lpad(F.bin(col(x)), width, "0"))


def decode(s) -> Column:
    return F.conv(F.reverse(col(s)), 2, 10).cast("long")


def support(x, width: int) -> Column:
    places = F.sequence(F.lit(0), F.lit(width - 1))
    return F.filter(places, lambda i: F.call_function("shiftright", col(x), i).bitwiseAND(F.lit(1).cast("long")) == 1)


def gather(x, places: list[int]) -> Column:
    """The given bits of x, packed in the given order."""
    take = lambda i: F.shiftright(col(x), i).bitwiseAND(F.lit(1).cast("long"))
    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(take(p), k) for k, p in enumerate(places)])


def lift(x, masks: list[int]) -> Column:
    """XOR of the masks whose bit is set in x."""
    pick = [F.when(F.shiftright(col(x), i).bitwiseAND(F.lit(1).cast("long")) == 1, F.lit(m).cast("long")).otherwise(F.lit(0).cast("long")) for i, m in enumerate(masks)]
    return reduce(lambda a, b: a.bitwiseXOR(b), pick)


def power_of(base: int, exponent: Column, most: int) -> Column:
    """Exact base**exponent for 0 <= exponent <= most, by a literal table (floating pow isn't exact)."""
    return F.element_at(F.array(*[F.lit(base**i).cast("long") for i in range(most + 1)]), exponent.cast("int") + 1)


def combination_order(x, width: int) -> Column:
    """Sorts descending as supports of one weight sort ascending."""
    return encode(x, width)


def euclidean(a: Column, b: Column) -> Column:
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(square, F.lit(0.0), lambda s, x: s + x))


def parse_labels(labels: Column, half: int) -> Column:
    """Array of labels such as L3 or R0 to a mask; null where one is malformed, repeated or out of range."""
    side = lambda s: F.regexp_extract(s, r"^([LR])(0|[1-9][0-9]*)$", 1)
    number = lambda s: F.regexp_extract(s, r"^([LR])(0|[1-9][0-9]{0,3})$", 2).try_cast("int")
    place = F.transform(labels, lambda s: F.when((side(s) != "") & (number(s) < half), number(s) + F.when(side(s) == "R", half).otherwise(0)))
    good = (F.size(F.array_distinct(place)) == F.size(labels)) & ~F.exists(place, lambda p: p.isNull())
    mask = F.aggregate(place, F.lit(0).cast("long"), lambda m, p: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), p)))
    return F.when(good, mask)
