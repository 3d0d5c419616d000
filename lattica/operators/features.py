"""Feature generation from compositions, groups and numbers.

Compositions are parsed and aggregated once for each distinct formula; callers join the features
back by formula.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.formula import SYMBOLS, fractions

GAS = 8.314462618


def element_features(parts: DataFrame, table: DataFrame, formula: str, kinds: tuple[str, ...] = ("composition_avg", "arithmetic_avg", "max", "min", "difference")) -> DataFrame:
    """Long rows (formula, feature, value): statistics of every element property over a formula.

    parts: (formula, element, amount). A missing property adds nothing to sums, and counts in the
    arithmetic average's number of elements.
    """
    both = parts.join(F.broadcast(table.select("element", "property", "value")), "element")  # 118 elements a property
    v, a = F.col("value"), F.col("amount")
    each = {
        "composition_avg": ("composition_average", F.sum(F.coalesce(v, F.lit(0.0)) * a) / F.sum(a)),
        "arithmetic_avg": ("arithmetic_average", F.coalesce(F.sum(v), F.lit(0.0)) / F.count("*")),
        "max": ("max_value", F.max(v)),
        "min": ("min_value", F.min(v)),
        "difference": ("difference", F.max(v) - F.min(v)),
    }
    named = [each[k] for k in kinds]
    wide = both.groupBy(formula, "property").agg(*[x.alias(n) for n, x in named])
    long = wide.unpivot([formula, "property"], [n for n, _ in named], "kind", "value")
    return long.select(formula, F.concat_ws("_", "property", "kind").alias("feature"), "value")


def widen(long: DataFrame, key: str, names: list[str] | None = None) -> DataFrame:
    """One column per feature, in the order of their names."""
    names = names or sorted(r[0] for r in long.select("feature").distinct().collect())
    return long.groupBy(key).agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names])


def site_features(df: DataFrame, table: DataFrame, formula: str, exploded: DataFrame) -> DataFrame:
    """Long rows (formula, site, feature, value) for formulas written as sites.

    exploded: (formula, site, element, amount).
    """
    keyed = exploded.withColumn("__key", F.struct(formula, "site"))
    out = element_features(keyed.select("__key", "element", "amount"), table, "__key")
    return out.select(f"__key.{formula}", "__key.site", F.concat(F.lit("Site"), F.col("__key.site").cast("string"), F.lit("_"), F.col("feature")).alias("feature"), "value")


def positional_features(parts: DataFrame, table: DataFrame, formula: str, most: int = 8) -> DataFrame:
    """Long rows (formula, feature, value): the properties of a formula's elements in the order of their symbols."""
    listed = parts.groupBy(formula).agg(F.slice(F.array_sort(F.collect_set("element")), 1, most).alias("els")).select(formula, F.posexplode("els").alias("i", "element"))
    both = listed.join(F.broadcast(table.select("element", "property", "value")), "element")
    return both.select(formula, F.concat(F.lit("Element"), (F.col("i") + 1).cast("string"), F.lit("_"), F.col("property")).alias("feature"), "value")


def site_couplings(per_site: DataFrame, formula: str) -> DataFrame:
    """Long rows (formula, feature, value): means of two sites' averages, and the span of both for differences."""
    each = per_site.select(formula, "site", F.regexp_replace("feature", "^Site[0-9]+_", "").alias("name"), "value")
    other = each.select(F.col(formula).alias("__f"), F.col("site").alias("__s"), F.col("name").alias("__n"), F.col("value").alias("__v"))
    both = each.join(other, (F.col(formula) == F.col("__f")) & (F.col("name") == F.col("__n")) & (F.col("site") < F.col("__s")))
    name = F.concat(F.lit("Site"), F.col("site").cast("string"), F.lit("Site"), F.col("__s").cast("string"), F.lit("_"), F.col("name"))
    value = F.when(F.col("name").endswith("max_value"), F.greatest("value", "__v")).when(F.col("name").endswith("min_value"), F.least("value", "__v")).otherwise((F.col("value") + F.col("__v")) / 2)
    return both.select(formula, name.alias("feature"), value.alias("value"))


def element_fractions(parts: DataFrame, formula: str) -> DataFrame:
    """One row per formula with a column for each of the 118 elements."""
    f = fractions(parts, formula)
    return f.groupBy(formula).agg(*[F.coalesce(F.sum(F.when(F.col("element") == e, F.col("fraction"))), F.lit(0.0)).alias(e) for e in SYMBOLS])


def polynomial(df: DataFrame, columns: list[str], degree: int = 2, interaction_only: bool = False, bias: bool = True) -> DataFrame:
    """df with the products of up to `degree` columns, named by their factors."""
    choose = itertools.combinations if interaction_only else itertools.combinations_with_replacement
    out = {"1": F.lit(1.0)} if bias else {}
    for d in range(1, degree + 1):
        for combo in choose(columns, d):
            powers = [(c, len(list(g))) for c, g in itertools.groupby(combo)]
            name = " ".join(c if n == 1 else f"{c}^{n}" for c, n in powers)
            value = F.lit(1.0)
            for c in combo:
                value = value * F.col(c)
            out[name if len(combo) > 1 else f"{name}^1"] = value
    return df.select("*", *[x.alias(n) for n, x in out.items()])


#: Columns that a column's values may become.
MOST_COLUMNS = 1000


def one_hot_group(df: DataFrame, column: str) -> DataFrame:
    """df with <column>_0, <column>_1, ... for the column's values in order."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(MOST_COLUMNS + 1).collect()]
    if len(values) > MOST_COLUMNS:
        raise ValueError(f"{column} has more than {MOST_COLUMNS} values, too many for columns")
    return df.withColumns({f"{column}_{i}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for i, v in enumerate(values)})


def one_hot_elements(parts: DataFrame, formula: str) -> DataFrame:
    """One row per formula with has_<element> for every element that occurs, in the order of symbols."""
    names = sorted(r[0] for r in parts.select("element").distinct().collect())
    return parts.groupBy(formula).agg(*[F.max((F.col("element") == e).cast("double")).alias(f"has_{e}") for e in names])


def composition_statistics(parts: DataFrame, table: DataFrame, formula: str, sums: bool = False) -> DataFrame:
    """Long rows (formula, feature, value): avg, dev, range, max, min and mode of properties, weighted by fraction.

    mode: the least value among the elements of the greatest fraction. Missing properties are zero, and so are
    all properties of an element that the table doesn't have.
    """
    parts = parts.where(~F.col(formula).contains("x"))
    named = table.select("property").distinct()  # as many rows as properties
    f = fractions(parts, formula).join(F.broadcast(named)).join(F.broadcast(table.select("element", "property", "value")), ["element", "property"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    keys = [formula, "property"]
    stats = f.groupBy(*keys).agg(F.sum(F.col("fraction") * F.col("value")).alias("avg"), F.max("value").alias("max"), F.min("value").alias("min"), F.max("fraction").alias("__top"), F.sum(F.col("amount") * F.col("value")).alias("sum"), F.collect_list(F.struct("fraction", "value")).alias("__each"))
    dev = F.aggregate("__each", F.lit(0.0), lambda s, x: s + x["fraction"] * F.abs(x["value"] - F.col("avg")))
    mode = F.array_min(F.transform(F.filter("__each", lambda x: x["fraction"] == F.col("__top")), lambda x: x["value"]))
    wide = stats.select(*keys, "avg", dev.alias("dev"), (F.col("max") - F.col("min")).alias("range"), "max", "min", mode.alias("mode"), "sum")
    names = ["avg", "dev", "range", "max", "min", "mode"] + (["sum"] if sums else [])
    return wide.unpivot(keys, names, "kind", "value").select(formula, F.concat_ws("_", "kind", "property").alias("feature"), "value")


def alloy_descriptors(parts: DataFrame, radius: DataFrame, electronegativity: DataFrame, formula: str) -> DataFrame:
    """Mean radius and electronegativity, mixing entropy, size mismatch delta and packing gamma.

    radius, electronegativity: (element, value). The mixing enthalpy isn't offered.
    """
    f = fractions(parts, formula).join(F.broadcast(radius.select("element", F.col("value").alias("r"))), "element").join(F.broadcast(electronegativity.select("element", F.col("value").alias("e"))), "element")
    stats = f.groupBy(formula).agg(F.sum(F.col("fraction") * F.col("r")).alias("r_mean"), F.sum(F.col("fraction") * F.col("e")).alias("e_mean"), (-GAS * F.sum(F.col("fraction") * F.ln("fraction"))).alias("s_mix"), F.min("r").alias("lo"), F.max("r").alias("hi"), F.sum(F.col("fraction") * F.col("r") * F.col("r")).alias("rr"))
    m = F.col("r_mean")
    packed = lambda r: 1 - F.sqrt((F.pow(r + m, 2) - m * m) / F.pow(r + m, 2))
    # sum f (1 - r/m)^2 = sum f r^2 / m^2 - 1
    delta = F.sqrt(F.greatest(F.col("rr") / (m * m) - 1, F.lit(0.0)))
    return stats.select(formula, "r_mean", "e_mean", "s_mix", delta.alias("delta"), (packed(F.col("lo")) / packed(F.col("hi"))).alias("gamma"))


def element_matrix(parts: DataFrame, formula: str, most: int = 16) -> DataFrame:
    """Rows (formula, z array, fraction array): elements by falling amount, then symbol, at most `most`."""
    number = F.map_from_arrays(F.array(*[F.lit(e) for e in SYMBOLS]), F.array(*[F.lit(i + 1) for i in range(len(SYMBOLS))]))
    listed = fractions(parts, formula).groupBy(formula).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("amount")).alias("m"), "element", "fraction"))), 1, most).alias("l"))
    return listed.select(formula, F.transform("l", lambda x: F.element_at(number, x["element"])).alias("z"), F.transform("l", lambda x: x["fraction"]).alias("fraction"))


def collapsed(matrix: DataFrame, table: DataFrame, formula: str) -> DataFrame:
    """Statistics of properties over the elements of a matrix from element_matrix, the sum included.

    table: (element, z, property, value).
    """
    each = matrix.select(formula, F.explode(F.arrays_zip("z", "fraction")).alias("e")).select(formula, F.col("e.z").alias("z"), F.col("e.fraction").alias("amount"))
    parts = each.join(F.broadcast(table.select("z", "element").distinct()), "z")  # 118 elements
    return composition_statistics(parts.select(formula, "element", "amount"), table, formula, sums=True)


def element_prevalence(parts: DataFrame) -> DataFrame:
    return parts.groupBy("element").agg(F.sum("amount").alias("amount"), F.count("*").alias("formulas"))


def drop_pure_elements(parts: DataFrame, formula: str) -> DataFrame:
    mixed = parts.groupBy(formula).agg(F.count("*").alias("__n")).where("__n <> 1").drop("__n")
    return parts.join(mixed, formula, "left_semi")


def most_stable(entries: DataFrame, formula: str, energy: str) -> DataFrame:
    """The entry of least energy above the hull for each formula; ties by the other columns' order."""
    rest = [c for c in entries.columns if c not in (formula, energy)]
    return entries.groupBy(formula).agg(F.min(F.struct(energy, *rest)).alias("e")).select(formula, "e.*")
