"""The best partner of every member of a review group, without pairing the group.

A pair's score adds up which fields agree and whether the names are close. A
member therefore asks, for every set of fields, for the first row of the other
side that agrees on that set: rows are told apart by the values of the set, not
compared. Names that are close are found once per group and distinct name: by
pairing the names where one side has few, else by the q-gram join of ``alike``.
All steps are linear in the members. Groups of up to ``GROUP_ROWS`` members are
dealt whole to tasks, which work on arrays of many groups at a time; larger ones
are joined by what their members ask for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.staging import materialize
from .alike import Bound, indel_bound, levenshtein_bound, near_texts
from .match import name_similarity, token_sort

FIELDS = ("dob", "birth_year", "last_name_prefix3", "location_state")
NAME_CLOSE = 0.90
#: Rows of one side that join one row of the other in a task.
SPLIT_ROWS = 50_000
#: Members of a group that a task may hold; larger groups go by joins.
GROUP_ROWS = 100_000
#: Rows that a task takes, and rows of whole groups that it works on at once.
TASK_ROWS, BATCH_ROWS = 100_000, 100_000
#: The names of a group are paired if that makes at most so many pairs per name.
PAIRS_PER_NAME = 256


def field_points(score: str, fields: tuple[str, ...] | frozenset) -> int:
    """The points that a pair has for agreeing on exactly these fields."""
    if score == "signals":
        return len(fields)
    born = 3 if "dob" in fields else 2 if "birth_year" in fields else 0
    return born + (2 if "last_name_prefix3" in fields else 0) + (1 if "location_state" in fields else 0)


#: The points of close names.
NAME_POINTS = {"signals": 1, "weighted": 2}


def _further_sets(given: tuple[str, ...]) -> list[tuple[str, ...]]:
    """All sets of the other fields, each after the one without its last field."""
    rest = [f for f in FIELDS if f not in given]
    return [some for size in range(len(rest) + 1) for some in combinations(rest, size)]


def _bound(method: str) -> Bound:
    return levenshtein_bound(NAME_CLOSE) if method == "edit" else indel_bound(NAME_CLOSE)


def _settings(score: str, given: tuple[str, ...]) -> Column:
    """For every set of further fields that a row has: the points of agreeing on it, and its values."""
    sets = []
    for some in _further_sets(given):
        present = F.lit(True)
        for f in some:
            present = present & (F.col(f) != "")
        values = F.concat_ws("\x1f", F.lit(",".join(some)), *some)
        sets.append(F.when(present, F.struct(F.lit(field_points(score, {*given, *some})).alias("points"), values.alias("values"))))
    return F.filter(F.array(*sets), lambda s: s.isNotNull())


def _salted(rows: DataFrame, n: str) -> DataFrame:
    """Rows of one side with a salt below the number of tasks that their group's side is worth."""
    return rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col(n) / SPLIT_ROWS)).cast("int"))


def _repeated(firsts: DataFrame) -> DataFrame:
    """The first rows, once for every salt of the side that asks for them."""
    return firsts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.ceil(F.col("askers") / SPLIT_ROWS).cast("int") - 1))).drop("askers")


def best_partners(left: DataFrame, right: DataFrame, given: tuple[str, ...], score: str, method: str) -> DataFrame:
    """(side, group, row, points, partner): for each member the row of the other side with most points, of equal ones the first.

    Both sides have ``group``, ``row``, the fields, ``full_name_norm``, ``n_old`` and ``n_new``; members of a group
    agree on the fields ``given``.
    """
    name = F.col("full_name_norm") if score == "signals" else token_sort("full_name_norm")
    sides = {}
    for side, rows in (("old", left), ("new", right)):
        rows = rows.select("group", "row", "n_old", "n_new", name.alias("title"), F.explode(_settings(score, given)).alias("s"))
        sides[side] = rows.select("group", "row", "n_old", "n_new", "title", "s.points", "s.values")

    names = {s: rows.select("group", "title").where("title <> ''").distinct() for s, rows in sides.items()}
    candidates = near_texts(names["old"], names["new"], _bound(method), ["group"])
    close = candidates.where(name_similarity(F.col("title"), F.col("other"), method) >= NAME_CLOSE)

    found = []
    for side, other in (("old", "new"), ("new", "old")):
        asking, n = sides[side], f"n_{side}"
        first = lambda *more: sides[other].groupBy("group", "values", *more).agg(F.min("row").alias("partner"), F.max(n).alias("askers"))  # noqa: E731, B023
        plain = _salted(asking, n).join(_repeated(first()).hint("merge"), ["group", "values", "salt"]).select("group", "row", "points", "partner")
        near = close if side == "old" else close.select("group", F.col("other").alias("title"), F.col("title").alias("other"))
        # The rows that a name brings together: one first row per near name and values, combined before the members ask.
        named = near.join(first("title").withColumnRenamed("title", "other").hint("merge"), ["group", "other"])
        named = named.groupBy("group", "title", "values").agg(F.min("partner").alias("partner"), F.max("askers").alias("askers"))
        by_name = _salted(asking, n).join(_repeated(named).hint("merge"), ["group", "title", "values", "salt"])
        by_name = by_name.select("group", "row", (F.col("points") + NAME_POINTS[score]).alias("points"), "partner")
        best = plain.unionByName(by_name).groupBy("group", "row").agg(F.min(F.struct((-F.col("points")).alias("less"), "partner")).alias("best"))
        found.append(best.select(F.lit(side).alias("side"), "group", "row", (-F.col("best.less")).alias("points"), F.col("best.partner").alias("partner")))
    return found[0].unionByName(found[1])


def _title(score: str) -> Column:
    return F.col("full_name_norm") if score == "signals" else token_sort("full_name_norm")


def _close_names(members: DataFrame, score: str, method: str) -> DataFrame:
    """(group, title, other): the different names of each group, old and new, that are close."""
    titles = members.select("group", "side", _title(score).alias("title")).where("title <> ''")
    sets = titles.groupBy("group").agg(*[F.collect_set(F.when(F.col("side") == s, F.col("title"))).alias(s) for s in ("old", "new")])
    n, m = F.size("old"), F.size("new")
    sets = materialize(sets.where((n > 0) & (m > 0)).withColumn("few", n * m <= PAIRS_PER_NAME * (n + m)), "names")
    bound = _bound(method)
    pairs = sets.where("few").select("group", "new", F.explode("old").alias("title")).select("group", "title", F.explode("new").alias("other"))
    if not sets.where("not few").isEmpty():
        named = [sets.where("not few").select("group", F.explode(s).alias("title")) for s in ("old", "new")]
        pairs = pairs.unionByName(near_texts(*named, bound, ["group"]))
    n, m = F.char_length("title"), F.char_length("other")
    edits = bound.edits(n, m)
    # Each insertion or deletion is a step of the Levenshtein distance.
    near = pairs.where((F.col("title") != F.col("other")) & (F.abs(n - m) <= edits)).where(F.levenshtein("title", "other") <= edits)
    return near.where(name_similarity(F.col("title"), F.col("other"), method) >= NAME_CLOSE)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that come sorted by them."""
    held, n, least = [], 0, BATCH_ROWS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < least:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        cut = pc.index(rows["group"], rows["group"][-1]).as_py()
        if cut:
            yield rows.slice(0, cut)
        held, n = rows.slice(cut).to_batches(), len(rows) - cut
        least = max(BATCH_ROWS, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _coded(column: pa.ChunkedArray) -> np.ndarray:
    """A number for each value, in no order."""
    return pc.fill_null(column.combine_chunks().dictionary_encode().indices, -1).to_numpy().astype(np.int64)


def _ranks(column: pa.ChunkedArray) -> np.ndarray:
    """The place of each value among the different ones, -1 for null."""
    coded = column.combine_chunks().dictionary_encode()
    place = np.empty(len(coded.dictionary) + 1, np.int64)
    place[pc.array_sort_indices(coded.dictionary).to_numpy()] = np.arange(len(coded.dictionary))
    place[-1] = -1
    return place[pc.fill_null(coded.indices, -1).to_numpy()]


def _firsts(keys: np.ndarray, ranks: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
    """The different keys, sorted, and the smallest rank of each, all below ``none``."""
    both = np.sort(keys * none + ranks)
    keys = both // none
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], (both - keys * none)[first]


def _looked_up(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, none: int) -> np.ndarray:
    keys, ranks = table
    if not len(keys):
        return np.full(len(wanted), none)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, ranks[at], none)


def _ranges(start: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, place) of every place in ranges given by their starts and lengths."""
    which = np.repeat(np.arange(len(start)), held)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(held) - held, held) + start[which]


def _pairs_of_groups(rows: pa.Table, given: tuple[str, ...], score: str) -> tuple[np.ndarray, ...]:
    """(member, its best partner) as places in ``rows``, whole groups with their close names, and by row n_old and n_new."""
    group, kind = _coded(rows["group"]), rows["kind"].to_numpy()
    sizes = np.stack([np.bincount(group[kind == k], minlength=group.max() + 1) for k in (0, 1)])
    place = np.flatnonzero((kind < 2) & (sizes.min(axis=0)[group] > 1))
    close = np.flatnonzero(kind == 2)
    own = rows["full_name_norm" if score == "signals" else "title"].take(place)
    titles = _coded(pa.chunked_array([*own.chunks, *rows["title"].take(close).chunks, *rows["other"].take(close).chunks], pa.string()))
    title, pairs = titles[:len(place)], titles[len(place):].reshape(2, -1)
    named = pc.not_equal(own, "").combine_chunks().to_numpy(zero_copy_only=False)
    n_titles = int(titles.max(initial=0)) + 1
    close_group = group[close]
    side, group, rank = kind[place], group[place], _ranks(rows["row"].take(place))
    none = len(place) + 1  # above every rank
    best_points, best = np.full(len(place), -1), np.full(len(place), none)

    def offer(rows_asking: np.ndarray, points: int, partner: np.ndarray) -> None:
        more = (partner < none) & ((points > best_points[rows_asking]) | ((points == best_points[rows_asking]) & (partner < best[rows_asking])))
        best_points[rows_asking[more]], best[rows_asking[more]] = points, partner[more]

    # The names near a new name, and those near an old one, by group and name.
    near = []
    for own_titles, others in ((pairs[0], pairs[1]), (pairs[1], pairs[0])):
        order = np.argsort(close_group * n_titles + others, kind="stable")
        near.append(((close_group * n_titles + others)[order], own_titles[order]))
    coded = {f: _coded(rows[f].take(place)) for f in FIELDS if f not in given}
    filled = {f: pc.not_equal(rows[f].take(place), "").combine_chunks().to_numpy(zero_copy_only=False) for f in coded}
    values, present = {(): group}, {(): rank >= 0}
    for some in _further_sets(given):
        if some:
            last = coded[some[-1]]
            values[some] = np.unique(values[some[:-1]] * (last.max(initial=0) + 1) + last, return_inverse=True)[1]
            present[some] = present[some[:-1]] & filled[some[-1]]
        points = field_points(score, {*given, *some})
        value, here = values[some], present[some]
        for me in (0, 1):
            asking, other = np.flatnonzero(here & (side == me)), np.flatnonzero(here & (side != me))
            offer(asking, points, _looked_up(_firsts(value[other], rank[other], none), value[asking], none))
            # By name: the first row of each name, then of each name near it.
            other = other[named[other]]
            keys, first = _firsts(value[other] * n_titles + title[other], rank[other], none)
            known, met = near[me]
            if len(known):
                group_of = np.zeros(int(value.max(initial=0)) + 1, np.int64)
                group_of[value] = group
                wanted = group_of[keys // n_titles] * n_titles + keys % n_titles
                low, high = np.searchsorted(known, wanted, "left"), np.searchsorted(known, wanted, "right")
                which, at = _ranges(low, high - low)
                keys, first = _firsts(np.concatenate([keys, keys[which] // n_titles * n_titles + met[at]]), np.concatenate([first, first[which]]), none)
            asking = asking[named[asking]]
            offer(asking, points + NAME_POINTS[score], _looked_up((keys, first), value[asking] * n_titles + title[asking], none))

    # Rows with one number ask as one and are met as one.
    number = (group * 2 + side) * none + 1 + rank
    _, alike = np.unique(number, return_inverse=True)
    told = np.lexsort((best, -best_points, alike))
    first = told[np.unique(alike[told], return_index=True)[1]]
    best = best[first][alike]
    asking = np.flatnonzero((rank >= 0) & (best < none))
    order = np.argsort(number, kind="stable")
    wanted = (group[asking] * 2 + 1 - side[asking]) * none + 1 + best[asking]
    low, high = np.searchsorted(number[order], wanted, "left"), np.searchsorted(number[order], wanted, "right")
    which, at = _ranges(low, high - low)
    member, partner = asking[which], order[at]
    return place[member], place[partner], sizes[0][group[member]], sizes[1][group[member]]


def partners_in_groups(members: DataFrame, given: tuple[str, ...], score: str, method: str) -> DataFrame:
    """(side, group, row, partner, n_old, n_new, the fields and ``full_name_norm`` of both): the best partner, as ``best_partners``, of each member.

    ``members`` of both sides have ``side``, ``group``, ``row``, the fields and ``full_name_norm``; a group that does
    not repeat on both sides is left out. A group is one task's, so it may have no more than ``GROUP_ROWS`` members.
    """
    shown = [*FIELDS, "full_name_norm"]
    kinds = dict(members.dtypes)
    nothing = F.lit(None).cast("string")
    title = nothing if score == "signals" else _title(score)
    rows = members.select("group", (F.col("side") == "new").cast("int").alias("kind"), "row", *shown, title.alias("title"), nothing.alias("other"))
    close = _close_names(members, score, method).select(
        "group", F.lit(2).alias("kind"), F.lit(None).cast(kinds["row"]).alias("row"), *[nothing.alias(c) for c in shown], "title", "other")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _whole_groups(batches):
            member, partner, n_old, n_new = _pairs_of_groups(part, given, score)
            first = part["kind"].to_numpy()[member] == 0
            old, new = part.select(shown).take(np.where(first, member, partner)), part.select(shown).take(np.where(first, partner, member))
            found = pa.table(
                [pa.array(np.where(first, "old", "new"), pa.string()), part["group"].take(member), part["row"].take(member), part["row"].take(partner),
                 pa.array(n_old, pa.int64()), pa.array(n_new, pa.int64()), *old.columns, *new.columns],
                names=["side", "group", "row", "partner", "n_old", "n_new", *[f"old_{c}" for c in shown], *[f"new_{c}" for c in shown]])
            yield from found.to_batches(max_chunksize=10_000)

    tasks = max(2, -(-members.count() // TASK_ROWS))
    dealt = rows.unionByName(close).repartition(tasks, "group").sortWithinPartitions("group")
    kind = kinds["row"]
    schema = f"side string, group string, row {kind}, partner {kind}, n_old long, n_new long, " + ", ".join(f"{p}_{c} string" for p in ("old", "new") for c in shown)
    return dealt.mapInArrow(pair, schema)
