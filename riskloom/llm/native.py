"""Small SQL-expression helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Characters that end a word.
SPACES = "\t\n\x0b\x0c\r "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.array_remove(F.split(F.translate(text, SPACES[:-1], " " * 5), " "), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` lie in ``chars``."""
    return F.length(text) - F.length(F.translate(text, chars, ""))


def log_gamma(x: Column) -> Column:
    """log(gamma(x)) for x >= 1, to about 1e-12, by Stirling's series eight steps up."""
    z = x + F.lit(8.0)
    step = F.lit(0.0)
    for i in range(8):
        step = step + F.log(x + F.lit(float(i)))
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5))
    return (z - 0.5) * F.log(z) - z + F.lit(0.9189385332046727) + series - step


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Binomial(n, rate) <= k) for k <= n * rate; 1 beyond.

    Terms further than 40 deviations below k are left out (under 1e-80 of the sum).
    """
    kd, nd = k.cast("double"), n.cast("double")
    first = (
        log_gamma(nd + 1) - log_gamma(kd + 1) - log_gamma(nd - kd + 1) + kd * F.log(F.lit(rate)) + (nd - kd) * F.log(F.lit(1 - rate))
    )
    low = F.greatest(F.lit(1), k - F.ceil(40 * F.sqrt(nd * rate)) - 50).cast("long")
    down = F.when(k >= 1, F.sequence(k.cast("long"), low, F.lit(-1).cast("long"))).otherwise(F.array().cast("array<long>"))
    start = F.struct(F.lit(1.0).alias("sum"), F.lit(1.0).alias("term"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] * j * (1 - rate) / ((nd - j + 1) * rate)
        return F.struct((acc["sum"] + term).alias("sum"), term.alias("term"))

    total = F.aggregate(down, start, add, lambda acc: acc["sum"])
    return F.when((n <= 0) | (kd > nd * rate), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(first) * total))
