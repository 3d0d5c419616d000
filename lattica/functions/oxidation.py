"""Oxidation states of the elements of a formula, by balancing charges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Common oxidation states, as in general chemistry textbooks. Fixed values; pass others to use them instead.
STATES: dict[str, tuple[int, ...]] = {
    "H": (1, -1), "Li": (1,), "Na": (1,), "K": (1,), "Rb": (1,), "Cs": (1,), "Be": (2,), "Mg": (2,), "Ca": (2,), "Sr": (2,), "Ba": (2,),
    "B": (3,), "Al": (3,), "Ga": (3,), "In": (3,), "Tl": (1, 3), "C": (4, 2, -4), "Si": (4, -4), "Ge": (4, 2), "Sn": (4, 2), "Pb": (2, 4),
    "N": (-3, 3, 5), "P": (5, 3, -3), "As": (3, 5, -3), "Sb": (3, 5, -3), "Bi": (3,), "O": (-2,), "S": (-2, 4, 6), "Se": (-2, 4, 6), "Te": (-2, 4, 6),
    "F": (-1,), "Cl": (-1,), "Br": (-1,), "I": (-1,), "Sc": (3,), "Y": (3,), "La": (3,), "Ce": (3, 4), "Ti": (4, 3, 2), "Zr": (4,), "Hf": (4,),
    "V": (5, 4, 3, 2), "Nb": (5,), "Ta": (5,), "Cr": (3, 6, 2), "Mo": (6, 4), "W": (6, 4), "Mn": (2, 3, 4, 7), "Fe": (3, 2), "Co": (2, 3), "Ni": (2,),
    "Cu": (2, 1), "Ag": (1,), "Zn": (2,), "Cd": (2,), "Hg": (2, 1),
}
#: Charge up to which a formula counts as neutral.
NEUTRAL = 1e-6


def guess(parts: DataFrame, formula: str, states: dict[str, tuple[int, ...]] | None = None) -> DataFrame:
    """Rows (formula, charges), charges a map from element to oxidation state, null where none is found.

    parts: (formula, element, amount). Every element takes one of its states so that the charges add up to
    nothing. Of several ways that with the smallest spread, from the lowest to the highest state, is
    chosen, then the one with the lesser states in the order of the elements' symbols. A pure element has
    state 0; a formula with an element without states has none.

    Elements are added one after the other to the sums that can be reached so far. Of ways with one sum,
    one lowest and one highest state, the first is kept: only those can decide, so what is carried grows
    with the sums, not with the product of the states.
    """
    spark = parts.sparkSession
    table = spark.createDataFrame([(e, sorted(s)) for e, s in (states or STATES).items()], "element string, states array<int>")
    known = parts.join(F.broadcast(table), "element", "left")  # an entry for each element
    way = F.struct("element", "amount", "states")
    listed = known.groupBy(formula).agg(F.array_sort(F.collect_list(way)).alias("__e"))  # as many entries as elements
    start = F.array(F.struct(F.lit(0.0).alias("sum"), F.lit(99).alias("low"), F.lit(-99).alias("high"), F.array().cast("array<int>").alias("s")))

    def grown(acc: Column, e: Column) -> Column:
        more = F.flatten(F.transform(acc, lambda w: F.transform(F.coalesce(e["states"], F.array().cast("array<int>")), lambda q: F.struct(F.round(w["sum"] + e["amount"] * q, 9).alias("sum"), F.least(w["low"], q).alias("low"), F.greatest(w["high"], q).alias("high"), F.array_append(w["s"], q).alias("s")))))
        return F.array_sort(more)

    def first_of(ways: Column) -> Column:
        """Of ways in order, the first with each sum, lowest and highest state."""
        same = lambda a, b: (a["sum"] == b["sum"]) & (a["low"] == b["low"]) & (a["high"] == b["high"])
        return F.filter(ways, lambda w, i: (i == 0) | ~same(w, F.get(ways, i - 1)))

    ways = F.aggregate("__e", start, lambda acc, e: F.get(F.transform(F.array(grown(acc, e)), first_of), F.lit(0)))
    neutral = F.filter("__w", lambda w: F.abs(w["sum"]) <= NEUTRAL)
    best = F.array_min(F.transform(neutral, lambda w: F.struct((w["high"] - w["low"]).alias("spread"), w["s"].alias("s"))))
    names = F.transform("__e", lambda e: e["element"])
    pure = F.map_from_arrays(names, F.array(F.lit(0)))
    solved = listed.withColumn("__w", ways).withColumn("__b", best)
    charges = F.when(F.size("__e") == 1, pure).when(F.col("__b").isNotNull(), F.map_from_arrays(names, F.col("__b.s")))
    return solved.select(formula, charges.alias("charges"))


def states_of(guessed: DataFrame, element: str) -> DataFrame:
    """One row (n_total, n_guesses, n_atoms): formulas, those with a guess, and those whose guess has the element."""
    there = F.coalesce(F.map_contains_key("charges", F.lit(element)), F.lit(False))
    return guessed.agg(F.count("*").alias("n_total"), F.count("charges").alias("n_guesses"), F.count_if(there).alias("n_atoms"))


def with_state(guessed: DataFrame, element: str, name: str = "state") -> DataFrame:
    """guessed with the element's state, null where the formula has no guess or not the element."""
    return guessed.withColumn(name, F.try_element_at("charges", F.lit(element)))


def ionic(guessed: DataFrame, name: str = "ionic") -> DataFrame:
    """guessed with whether a guess with charges other than 0 was found."""
    return guessed.withColumn(name, F.coalesce(F.exists(F.map_values("charges"), lambda q: q != 0), F.lit(False)))
