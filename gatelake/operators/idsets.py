"""Sets of event numbers as words of 64 bits.

A word is a row: what of its 64 numbers are in a set is one long, a column for each set. So the sets of all samples are made in one aggregate
that packs ids before the shuffle, and union, intersection and difference, sizes and nesting are bit operations on columns. A row stands
for 64 numbers at most, so no group is large whatever the sizes of samples and populations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, BITS = 64, 6


def _word() -> Column:
    return F.shiftright(F.col("event_id").cast("long"), BITS)


def _bit() -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.col("event_id").cast("long").bitwiseAND(F.lit(WORD - 1)).cast("int"))


def _numbered(membership: DataFrame) -> DataFrame:
    kind = dict(membership.dtypes)["event_id"]
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"sets are of whole numbers; event_id is {kind}")
    return membership.where(F.col("event_id").isNotNull())


def packed(membership: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """keys, population, word, bits of every population."""
    return _numbered(membership).groupBy(*keys, "population", _word().alias("word")).agg(F.bit_or(_bit()).alias("bits"))


def beside(membership: DataFrame, populations: list[str], keys: tuple[str, ...] = ("sample_id",)) -> tuple[DataFrame, dict[str, Column]]:
    """keys, word and a column of bits for each of the populations, and the columns by population. Words that none of them touches have no row."""
    at = {p: f"_set{i}" for i, p in enumerate(dict.fromkeys(populations))}
    rows = _numbered(membership).where(F.col("population").isin(list(at)))
    sets = [F.coalesce(F.bit_or(F.when(F.col("population") == p, _bit())), F.lit(0).cast("long")).alias(c) for p, c in at.items()]
    return rows.groupBy(*keys, _word().alias("word")).agg(*sets), {p: F.col(c) for p, c in at.items()}


def union(first: Column, *more: Column) -> Column:
    return reduce(Column.bitwiseOR, more, first)


def intersection(first: Column, *more: Column) -> Column:
    return reduce(Column.bitwiseAND, more, first)


def difference(first: Column, *more: Column) -> Column:
    """What is in the first and in none of the others."""
    return first.bitwiseAND(F.bitwise_not(union(*more))) if more else first


HOW = {"or": union, "and": intersection, "not": difference}


def combined(membership: DataFrame, sets: dict[str, tuple[str, list[str]]], keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """Membership rows (keys, event_id, population) of new populations {name: ("or" | "and" | "not", populations)}, all in one aggregate.

    "not" gives what is in the first and in none of the others. A population without members is an empty set, and a set without members has no
    row. Repeated rows count once; null ids are left out.
    """
    words, at = beside(membership, [p for _, populations in sets.values() for p in populations], keys)
    made = [F.struct(F.lit(name).alias("population"), HOW[how](*[at[p] for p in populations]).alias("bits")) for name, (how, populations) in sets.items()]
    rows = words.select(*keys, "word", F.explode(F.array(*made)).alias("_made")).select(*keys, "word", "_made.population", "_made.bits")
    return unpacked(rows.where("bits <> 0"), keys, dict(membership.dtypes)["event_id"])


def unpacked(words: DataFrame, keys: tuple[str, ...] = ("sample_id",), kind: str = "bigint") -> DataFrame:
    """keys, event_id, population of packed sets."""
    places = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.call_function("shiftrightunsigned", F.col("bits"), i).bitwiseAND(F.lit(1).cast("long")) == 1)
    rows = words.select(*keys, "population", "word", F.explode(places).alias("_place"))
    return rows.select(*keys, (F.shiftleft("word", BITS) + F.col("_place")).cast(kind).alias("event_id"), "population")


def sizes(membership: DataFrame, sets: dict[str, tuple[str, list[str]]], keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """keys, population, n of the sets that `combined` makes, by counting bits: no set is unpacked. A set without members has n = 0 in every sample that one of its or others' parts is in."""
    words, at = beside(membership, [p for _, populations in sets.values() for p in populations], keys)
    counts = [F.sum(F.bit_count(HOW[how](*[at[p] for p in populations]))).cast("long").alias(f"_n{i}") for i, (how, populations) in enumerate(sets.values())]
    rows = words.groupBy(*keys).agg(*counts) if keys else words.agg(*counts)
    pairs = F.array(*[F.struct(F.lit(name).alias("population"), F.coalesce(F.col(f"_n{i}"), F.lit(0).cast("long")).alias("n")) for i, name in enumerate(sets)])
    return rows.select(*keys, F.explode(pairs).alias("_pair")).select(*keys, "_pair.population", "_pair.n")


def outside(membership: DataFrame, tree: DataFrame, keys: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """keys, population, n, n_outside for populations of tree(population, parent, and keys if samples have trees of their own) below another than the root: how many members their parent lacks."""
    words = packed(membership, keys)
    by = [k for k in keys if k in tree.columns]
    own = words.join(tree.where(F.col("parent") != "root").select(*by, "population", "parent"), [*by, "population"])
    above = words.select(*keys, "word", F.col("population").alias("parent"), F.col("bits").alias("_above"))
    both = own.join(above, [*keys, "word", "parent"], "left")
    lacking = F.bit_count(difference(F.col("bits"), F.coalesce("_above", F.lit(0).cast("long"))))
    return both.groupBy(*keys, "population").agg(F.sum(F.bit_count("bits")).cast("long").alias("n"), F.sum(lacking).cast("long").alias("n_outside"))
