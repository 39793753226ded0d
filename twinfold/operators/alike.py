"""Candidates for texts that few edits part, by an equi-join that loses no pair."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """``edits``: insertions and deletions that texts of two lengths may need; ``shortest``: the least share of a length that the other may have."""

    edits: Callable[[Column, Column], Column]
    shortest: float


def indel_bound(ratio: float) -> Bound:
    """Texts whose insertions and deletions are at most 1 - ``ratio`` of their length together."""
    return Bound(lambda n, m: F.floor((n + m) * (1 - ratio) + 1e-9), ratio / (2 - ratio))


def levenshtein_bound(ratio: float) -> Bound:
    """Texts whose Levenshtein distance is at most 1 - ``ratio`` of the longer one; a replacement is two edits."""
    return Bound(lambda n, m: 2 * F.floor(F.greatest(n, m) * (1 - ratio) + 1e-9), ratio)


def _prefix(bound: Bound, n: Column, m: Column, q: int) -> Column:
    """How many of its rarest q-grams a text of ``n`` characters must show to meet one of ``m``.

    Of D edits at most (D + n - m) / 2 delete a character of it and so at most q of its q-grams; the others insert one
    and break q - 1. One q-gram more than can be lost is shared, and so is the rarest common one.
    """
    edits = bound.edits(n, m)
    return (F.lit(q - 1) * edits + F.floor((edits + n - m) / 2) + 1).cast("int")


def _by_pairs(bound: Bound, n: Column, m: Column) -> Column:
    """Whether texts of these lengths have more pairs of characters than edits can break; else single characters are compared."""
    return (n - 1 >= _prefix(bound, n, m, 2)) & (m - 1 >= _prefix(bound, m, n, 2))


def _grams(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, title, n, q, gram): the characters and the pairs of characters of each text, repeats numbered."""
    n = F.char_length("title")
    places = lambda q: F.when(n >= q, F.sequence(F.lit(1), n - (q - 1)))
    grams = lambda q: F.transform(places(q), lambda i: F.struct(F.lit(q).alias("q"), F.col("title").substr(i, F.lit(q)).alias("g")))
    none = F.array().cast("array<struct<q: int, g: string>>")
    rows = texts.select(*keys, "title", n.alias("n"), F.explode(F.concat(grams(1), F.coalesce(grams(2), none))).alias("e"))
    counted = rows.groupBy(*keys, "title", "n", "e.q", "e.g").agg(F.count("*").alias("k"))
    one = counted.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))))
    return one.select(*keys, "title", "n", "q", F.concat("g", F.col("k").cast("string")).alias("gram"))


def _signatures(grams: DataFrame, rarity: DataFrame, bound: Bound, keys: list[str]) -> DataFrame:
    """(keys, title, n, m, q, gram): the q-grams one of which a text of ``m`` characters must show as well."""
    order = Window.partitionBy(*keys, "title", "q").orderBy(F.coalesce("seen", F.lit(0)), "gram")
    ranked = grams.join(rarity, ["q", "gram"], "left").withColumn("rank", F.row_number().over(order))
    n, m, q = F.col("n"), F.col("m"), F.col("q")
    least, most = F.ceil(n * bound.shortest - 1e-9), F.floor(n / bound.shortest + 1e-9)
    rows = ranked.withColumn("m", F.explode(F.sequence(least.cast("int"), most.cast("int"))))
    pairs = _by_pairs(bound, n, m)
    wanted = ((q == 2) & pairs & (F.col("rank") <= _prefix(bound, n, m, 2))) | ((q == 1) & ~pairs & (F.col("rank") <= _prefix(bound, n, m, 1)))
    return rows.where(wanted & (F.abs(n - m) <= bound.edits(n, m))).select(*keys, "title", "n", "m", "q", "gram")


def near_texts(left: DataFrame, right: DataFrame, bound: Bound, keys: list[str] | None = None) -> DataFrame:
    """(keys, title, other): every pair of texts within the bound, and some beyond it.

    Both sides have ``title`` and the ``keys`` that must agree; blank texts take no part. Texts meet through an
    equi-join on both lengths and a q-gram that texts so close must share, the ones rarest on the right first.
    """
    keys = keys or []
    sides = [_grams(s.where("title <> ''").select(*keys, "title").distinct(), keys) for s in (left, right)]
    rarity = sides[1].groupBy("q", "gram").agg(F.count("*").alias("seen"))
    mine = _signatures(sides[0], rarity, bound, keys)
    other = _signatures(sides[1], rarity, bound, keys).select(*keys, F.col("title").alias("other"), F.col("n").alias("m"), F.col("m").alias("n"), "q", "gram")
    return mine.join(other.hint("merge"), [*keys, "n", "m", "q", "gram"]).select(*keys, "title", "other").distinct()
