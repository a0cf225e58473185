"""Words, hash buckets and bag-of-words vectors of text columns.

Everything works within a row: no text is exploded and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a word is, and the width of a hashed vector.
WORD_PATTERN = "[a-z']+"
DIMENSIONS = 64


def words(text: Column) -> Column:
    """Runs of a-z and apostrophes in the lower-cased text; null has none."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def bucket(word: Column, dim: int = DIMENSIONS) -> Column:
    """The word's MD5 as a number, modulo ``dim``."""
    if not 0 < dim < 1 << 31:
        raise ValueError("dim must be from 1 to 2^31 - 1")
    digest = F.md5(word.cast("binary"))
    if 256 % dim == 0:  # the last byte decides
        return (F.conv(F.substring(digest, 31, 2), 16, 10).cast("int") % dim).cast("int")
    rest = F.lit(0).cast("bigint")
    for at in range(1, 33, 8):
        rest = (rest * (1 << 32) + F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")) % dim
    return rest.cast("int")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is looked at."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bag(text: Column, dim: int = DIMENSIONS) -> Column:
    """``array<struct<bucket, n>>``: the words' buckets in ascending order and how many words each has."""

    def ends(run: Column) -> Column:
        """Places, from 1, of the last of equal buckets."""
        last = F.size(run)
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == last) | (F.element_at(run, i) != F.element_at(run, F.least(i + 1, last))))

    def entries(run: Column, at: Column) -> Column:
        def entry(end: Column, i: Column) -> Column:
            before = F.when(i == 0, 0).otherwise(F.element_at(at, F.greatest(i, F.lit(1))))
            return F.struct(F.element_at(run, end).alias("bucket"), (end - before).cast("bigint").alias("n"))

        return F.transform(at, entry)

    found = F.sort_array(F.transform(words(text), lambda w: bucket(w, dim)))
    return _let(found, lambda run: _let(ends(run), lambda at: entries(run, at)))


def bag_squares(counts: Column) -> Column:
    """The squared norm of a bag, a whole number."""
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"] * x["n"])


def bag_weights(text: Column, dim: int = DIMENSIONS) -> Column:
    """``array<struct<bucket, weight>>``: the entries of ``bag`` over its norm; the bag is made once."""

    def scaled(counts: Column, root: Column) -> Column:
        return F.transform(counts, lambda x: F.struct(x["bucket"].alias("bucket"), (x["n"] / root).alias("weight")))

    return _let(bag(text, dim), lambda counts: _let(F.sqrt(bag_squares(counts).cast("double")), lambda root: scaled(counts, root)))


def bag_dot(counts: Column, other: Column) -> Column:
    """The inner product of a bag with a map from bucket to count, a whole number."""
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"] * F.coalesce(F.element_at(other, x["bucket"]), F.lit(0).cast("bigint")))


def bag_cosine(product: Column, squares: Column, other_squares: Column) -> Column:
    """Cosine similarity from whole numbers, so that equal texts have equal scores to the bit; 0 for empty bags."""
    zero = (squares == 0) | (other_squares == 0)
    return F.when(zero, F.lit(0.0)).otherwise(product.cast("double") / (F.sqrt(squares.cast("double")) * F.sqrt(other_squares.cast("double"))))


def dense(counts: Column, root: Column, dim: int = DIMENSIONS) -> Column:
    """A bag as a vector of ``dim`` numbers over its norm ``root``; an empty bag is the zero vector.

    Both should be columns of their own, since they are looked at for every entry.
    """

    def up_to(acc: Column, end: Column) -> Column:
        return F.concat(acc, F.array_repeat(F.lit(0.0), end - F.size(acc)))

    def step(acc: Column, x: Column) -> Column:
        return F.array_append(up_to(acc, x["bucket"]), x["n"].cast("double") / root)

    return F.aggregate(counts, F.array().cast("array<double>"), step, lambda acc: up_to(acc, F.lit(dim)))
