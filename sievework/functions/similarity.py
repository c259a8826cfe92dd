"""Similarity of token arrays and of vectors, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def coverage(needles: Column, haystack: Column, empty: float = 0.0) -> Column:
    """The share of the distinct needles that the haystack has; `empty` where there are none."""
    n = F.size(F.array_distinct(needles))
    return F.when(n > 0, F.size(F.array_intersect(needles, haystack)) / n).otherwise(F.lit(empty))


def jaccard(a: Column, b: Column) -> Column:
    """Shared of united elements, of at least one."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(F.array_union(a, b)))


def token_f1(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    p, r = shared / F.size(F.array_distinct(a)), shared / F.size(F.array_distinct(b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (shared > 0), 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def counts(tokens: Column) -> Column:
    """How often each distinct token occurs, in the order of array_distinct()."""
    return F.transform(F.array_distinct(tokens), lambda t: F.size(F.filter(tokens, lambda u: u == t)).cast("double"))


def term_cosine(a: Column, b: Column) -> Column:
    """The cosine of the counts of two token arrays; 0 where one is empty. For short texts: it counts in place."""
    each = lambda of: lambda t: F.size(F.filter(of, lambda u: u == t)).cast("double")
    product = F.aggregate(F.transform(F.array_intersect(a, b), lambda t: each(a)(t) * each(b)(t)), F.lit(0.0), lambda s, x: s + x)
    norm = lambda of: F.sqrt(F.aggregate(counts(of), F.lit(0.0), lambda s, x: s + x * x))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), product / (norm(a) * norm(b))).otherwise(F.lit(0.0))
