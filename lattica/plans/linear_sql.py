"""SQL of least-squares fits with a few features, by Cramer's rule: what the oracles of linear models need."""

from __future__ import annotations


def determinant(m: list[list[str]]) -> str:
    """The expansion along the first row, as an expression."""
    if len(m) == 1:
        return m[0][0]
    terms = [f"{'-' if j % 2 else '+'} {m[0][j]} * ({determinant([[*row[:j], *row[j + 1 :]] for row in m[1:]])})" for j in range(len(m))]
    return " ".join(terms)


def moments(xs: list[str], y: str) -> str:
    """Select list of the means and centred sums of products."""
    names = [*xs, y]
    means = [f"avg({c}) AS m_{c}" for c in names]
    return ", ".join(["count(*) AS n", *means, *[f"covar_pop({a}, {b}) * count(*) AS c_{a}_{b}" for i, a in enumerate(names) for b in names[i:]]])


def coefficients(xs: list[str], y: str, alpha: str = "0") -> str:
    """Select list b0 and b_<x>... over the moments; alpha penalises the coefficients' squares."""
    c = lambda a, b: f"c_{a}_{b}" if f"c_{a}_{b}" in moments(xs, y) else f"c_{b}_{a}"
    matrix = [[f"({c(a, b)} + {alpha})" if a == b else c(a, b) for b in xs] for a in xs]
    whole = determinant(matrix)
    beta = []
    for j in range(len(xs)):
        swapped = [[c(a, y) if k == j else matrix[i][k] for k in range(len(xs))] for i, a in enumerate(xs)]
        beta.append(f"(({determinant(swapped)}) / ({whole}))")
    level = " - ".join([f"m_{y}", *[f"{b} * m_{x}" for b, x in zip(beta, xs, strict=True)]])
    return ", ".join([f"{level} AS b0", *[f"{b} AS b_{x}" for b, x in zip(beta, xs, strict=True)]])


def fit(source: str, by: str, xs: list[str], y: str) -> str:
    """SELECT of one fit for each group of a table."""
    return f"SELECT {by}, {coefficients(xs, y)} FROM (SELECT {by}, {moments(xs, y)} FROM {source} GROUP BY {by})"


def predicted(xs: list[str]) -> str:
    return "(" + " + ".join(["b0", *[f"b_{x} * {x}" for x in xs]]) + ")"
