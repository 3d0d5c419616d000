"""Chemical formulas as columns.

Flat formulas are parsed by SQL functions; those with brackets by a small pandas function that
sees each distinct formula once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.workers import ship

ship(__name__)

#: Symbols by atomic number, a fixed list.
SYMBOLS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr Rf Db Sg Bh Hs Mt Ds Rg Cn Nh Fl Mc Lv Ts Og"
).split()

#: Subshells in the order in which they fill, from n + l and then n.
_FILLING = sorted(((n, l) for n in range(1, 8) for l in range(min(n, 4))), key=lambda x: (x[0] + x[1], x[0]))


def shells(z: int) -> dict[tuple[int, int], int]:
    """Electrons by (n, l) for atomic number z, by the order of filling."""
    out, left = {}, z
    for n, l in _FILLING:
        if left <= 0:
            break
        out[n, l] = min(left, 4 * l + 2)
        left -= out[n, l]
    return out


#: Atomic numbers of the noble gases, whose electrons are an element's core.
CORES = (0, 2, 10, 18, 36, 54, 86)


def element_rows() -> list[tuple[str, int, str, float]]:
    """(element, z, property, value) of what follows from the order of filling: a rule, not a table."""
    rows = []
    for z, symbol in enumerate(SYMBOLS, 1):
        filled, core = shells(z), shells(max(c for c in CORES if c < z))
        valence = [sum(e - core.get(shell, 0) for shell, e in filled.items() if shell[1] == l) for l in range(4)]
        open_ = [4 * l + 2 - valence[l] if valence[l] else 0 for l in range(4)]
        rows += [(symbol, z, "Number", float(z)), (symbol, z, "Row", float(max(n for n, _ in filled))), (symbol, z, "NValence", float(sum(valence)))]
        rows += [(symbol, z, f"N{name}Valence", float(valence[l])) for l, name in enumerate("spdf")]
        rows += [(symbol, z, f"N{name}Unfilled", float(open_[l])) for l, name in enumerate("spdf")]
    return rows


def element_table(spark: SparkSession, more: dict[str, list[float | None]] | None = None) -> DataFrame:
    """Rows (element, z, property, value); at most 118 for each property.

    more: further properties as lists by atomic number, such as those read by `read_property`.
    """
    rows = element_rows()
    for name, values in (more or {}).items():
        rows += [(SYMBOLS[i], i + 1, name, v) for i, v in enumerate(values[: len(SYMBOLS)])]
    return spark.createDataFrame(rows, "element string, z int, property string, value double")


def read_property(lines: list[str]) -> list[float | None]:
    """A property file has one value per line, line n for atomic number n; texts stand for missing values."""
    out = []
    for line in lines[: len(SYMBOLS)]:
        try:
            out.append(float(line.strip()))
        except ValueError:
            out.append(None)
    return out


# ---------------------------------------------------------------- parsing
def parse_flat(formula: Column) -> Column:
    """array<struct<element, amount>> of a formula without brackets; an element may occur again."""
    pattern = F.lit("([A-Z][a-z]?)([0-9]*[.]?[0-9]*)")
    names, amounts = F.regexp_extract_all(formula, pattern, F.lit(1)), F.regexp_extract_all(formula, pattern, F.lit(2))
    return F.zip_with(names, amounts, lambda e, a: F.struct(e.alias("element"), F.when(a == "", F.lit(1.0)).otherwise(a.cast("double")).alias("amount")))


_TOKEN = re.compile(r"([A-Z][a-z]?)|([(\[{])|([)\]}])|(\d+\.?\d*|\.\d+)")


def parse(formula: str) -> dict[str, float]:
    """Elements and amounts of a formula with nested brackets, such as Li3Fe2(PO4)3.

    '@' joins two parts. Anything that isn't part of a formula is an error.
    """
    text = formula.replace("@", "").replace(" ", "")
    stack: list[dict[str, float]] = [{}]
    last: dict[str, float] | None = None  # what a following number multiplies
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"{formula!r} can't be read from {text[at:]!r}")
        at = m.end()
        element, opens, closes, number = m.groups()
        if number:
            if last is None:
                raise ValueError(f"{formula!r}: a number without what it counts")
            for k, v in last.items():
                stack[-1][k] = stack[-1].get(k, 0.0) + v * (float(number) - 1)
            last = None
        elif opens:
            stack.append({})
            last = None
        else:
            if closes:
                if len(stack) == 1:
                    raise ValueError(f"{formula!r}: a bracket that wasn't opened")
                last = stack.pop()
            else:
                if element not in SYMBOLS:
                    raise ValueError(f"{formula!r}: no element {element}")
                last = {element: 1.0}
            for k, v in last.items():
                stack[-1][k] = stack[-1].get(k, 0.0) + v
    if len(stack) > 1:
        raise ValueError(f"{formula!r}: a bracket that isn't closed")
    return {k: v for k, v in stack[0].items() if abs(v) >= 1e-6}


def _parse_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def one(f):
        try:
            return list(parse(f).items()) if f is not None else None
        except ValueError:
            return None

    for formulas in batches:
        yield formulas.map(one)


def elements(df: DataFrame, formula: str) -> DataFrame:
    """Rows (formula, element, amount), one for each element of each distinct formula.

    Formulas that can't be read give no rows; `unreadable` lists them.
    """
    distinct = df.select(formula).where(F.col(formula).isNotNull()).distinct()
    flat = distinct.where(~F.col(formula).rlike(r"[^A-Za-z0-9.]")).select(formula, F.explode(parse_flat(F.col(formula))).alias("p"))
    reader = F.pandas_udf(_parse_batches, "array<struct<element:string,amount:double>>")
    deep = distinct.where(F.col(formula).rlike(r"[^A-Za-z0-9.]")).select(formula, F.explode(reader(formula)).alias("p"))
    both = flat.unionByName(deep).select(formula, "p.element", "p.amount")
    return both.groupBy(formula, "element").agg(F.sum("amount").alias("amount")).where(F.abs("amount") >= 1e-6)


def unreadable(df: DataFrame, formula: str) -> DataFrame:
    return df.select(formula).distinct().join(elements(df, formula).select(formula).distinct(), formula, "left_anti")


def fractions(parts: DataFrame, formula: str) -> DataFrame:
    """Rows (formula, element, amount, fraction)."""
    total = parts.groupBy(formula).agg(F.sum(F.abs("amount")).alias("__t"))
    return parts.join(total, formula).select(formula, "element", "amount", (F.col("amount") / F.col("__t")).alias("fraction"))


def sites(formula: Column) -> Column:
    """array<struct<site, part>> of a formula written as bracketed sites, such as [La0.75Sr0.25][Mn][O3]."""
    return F.transform(F.regexp_extract_all(formula, F.lit(r"\[([^\]]*)\]"), F.lit(1)), lambda part, i: F.struct((i + 1).alias("site"), part.alias("part")))


def chemical_system(formula: Column) -> Column:
    """The formula's letters only, as sorted symbols joined by '-'."""
    letters = F.regexp_replace(formula, "[^a-zA-Z]+", "")
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(letters, F.lit("([A-Z][a-z]?)"), F.lit(1)))), "-")
