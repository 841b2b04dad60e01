"""Small matrices as flat arrays of doubles, row by row, in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .special import let


def one_norm(m: Column, k: int) -> Column:
    """The greatest sum of absolute values of a column of a k by k matrix."""
    column = lambda j: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, i: s + F.abs(F.get(m, i * k + j)))
    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), column))


def inverse(m: Column, k: int, most: float = 1e10) -> Column:
    """The inverse of a k by k matrix by elimination with row exchanges; null for a null or non-finite entry, another size, a pivot of 0, or a condition number (in the
    1-norm) over ``most``."""
    places = F.sequence(F.lit(0), F.lit(k - 1))

    def eliminated(rows: Column, p: Column) -> Column:
        """rows with column p of the k by 2 k scheme made that of the unit matrix; null where every pivot is 0."""
        top = F.array_max(F.transform(F.sequence(p, F.lit(k - 1)), lambda i: F.struct(F.abs(F.get(F.get(rows, i), p)).alias("size"), (-i).alias("less"))))

        def below(t: Column) -> Column:
            r = -t["less"]
            pivot = F.get(F.get(rows, r), p)
            unit = lambda row: F.transform(row, lambda x: x / pivot)
            swapped = F.transform(rows, lambda row, i: F.when(i == r, F.get(rows, p)).otherwise(row))
            return let(unit(F.get(rows, r)), lambda u: F.transform(swapped, lambda row, i: F.when(i == p, u).otherwise(F.transform(row, lambda x, j: x - F.get(row, p) * F.get(u, j)))))

        return let(top, lambda t: F.when(t["size"] > 0, below(t)))

    def inverted(m: Column) -> Column:
        scheme = F.transform(places, lambda i: F.concat(F.slice(m, i * k + 1, F.lit(k)), F.transform(places, lambda j: F.when(i == j, 1.0).otherwise(0.0))))
        solved = F.aggregate(places, scheme, eliminated)
        return F.flatten(F.transform(solved, lambda row: F.slice(row, k + 1, k)))

    fine = (F.size(m) == k * k) & F.forall(m, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return let(F.when(fine, m), lambda v: let(inverted(v), lambda i: F.when(one_norm(v, k) * one_norm(i, k) <= most, i)))
