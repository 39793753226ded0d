"""One-to-one resolution of candidate pairs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blanks import text
from ..functions.text import lookup, pair_id
from ..sources.snapshots import ensure_columns
from ..sources.staging import materialize

# Evidence weight of each match source; others weigh 10.
SOURCE_SCORES = {
    "worker_id": "100", "recon_id": "90", "pk": "80",
    "last4_dob": "70", "dob_name": "60", "name_hire_date": "50",
}
OTHER_SCORE = 10
KEYS = ("worker_id", "recon_id", "pk")


def entity_key(side: str) -> Column:
    """First non-blank of worker id, reconciliation id and composite key."""
    parts = [F.nullif(text(f"{side}_{k}"), F.lit("")) for k in KEYS]
    return F.coalesce(*parts, F.lit(""))


def score_candidates(candidates: DataFrame) -> DataFrame:
    """Add entity keys, ``pair_id``, ``source_score`` and the exact-key flags."""
    df = ensure_columns(candidates, [f"{s}_{k}" for s in ("old", "new") for k in KEYS])
    source = F.coalesce(F.nullif(text("match_source"), F.lit("")), F.lit("unknown"))
    df = df.withColumns({
        "match_source": source,
        "old_entity_key": entity_key("old"),
        "new_entity_key": entity_key("new"),
    })
    exact = {
        f"exact_{k}": ((text(f"old_{k}") != "") & (text(f"old_{k}") == text(f"new_{k}"))).cast("int")
        for k in KEYS
    }
    weight = F.coalesce(lookup(SOURCE_SCORES, F.col("match_source")).cast("int"), F.lit(OTHER_SCORE))
    return df.withColumns({
        "pair_id": pair_id("old_entity_key", "new_entity_key"), "source_score": weight, **exact,
    })


@dataclass
class Resolution:
    pairs: DataFrame
    conflicts_old: DataFrame
    conflicts_new: DataFrame
    skipped_missing: DataFrame


def greedy_one_to_one(
    edges: DataFrame, old_key: str, new_key: str, rank: Column, order: str,
    stage: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """The ``order`` values kept by taking edges best first, each key used once.

    ``rank`` is compared first (greatest wins), then the smallest ``order``,
    which must be unique. An edge that is the best one of both its keys is kept
    by the sequential rule too, so each round keeps all of those at once, drops
    the edges of the used keys and goes on with the rest. Best edges are found
    with map-side aggregation; a key with many edges sends one row per task.
    """
    left = edges.select(
        F.col(old_key).alias("o"), F.col(new_key).alias("n"),
        rank.alias("rank"), (-F.col(order)).alias("neg"),
    )
    left = stage(left, "edges")
    kept: list[DataFrame] = []
    while not left.isEmpty():
        best = F.max(F.struct("rank", "neg", "o", "n")).alias("best")
        by_old = left.groupBy("o").agg(best).select("best.neg", "best.o", "best.n")
        by_new = left.groupBy("n").agg(best).select("best.neg")
        winners = stage(by_old.join(by_new, "neg"), "winners")
        kept.append(winners)
        left = left.join(winners.select("o"), "o", "left_anti")
        left = left.join(winners.select("n"), "n", "left_anti")
        left = stage(left.select("o", "n", "rank", "neg"), "edges")
    if not kept:
        return left.select((-F.col("neg")).alias(order))
    return reduce(DataFrame.unionByName, kept).select((-F.col("neg")).alias(order))


def resolve_one_to_one(
    candidates: DataFrame, order: str = "cand_ord",
    stage: Callable[[DataFrame, str], DataFrame] = materialize,
) -> Resolution:
    """Keep the best candidate per entity on both sides; report what was blocked."""
    scored = score_candidates(candidates)
    usable = (F.col("old_entity_key") != "") & (F.col("new_entity_key") != "")
    work = scored.where(usable)
    rank = F.struct("exact_worker_id", "exact_recon_id", "exact_pk", "source_score")
    kept = greedy_one_to_one(work, "old_entity_key", "new_entity_key", rank, order, stage)
    pairs = work.join(kept, order)
    shown = [c for c in scored.columns if c not in (
        "old_entity_key", "new_entity_key", "old_pk", "new_pk", "exact_recon_id", "exact_pk")]
    # A repeat of a kept pair is neither kept nor a conflict.
    blocked = work.join(pairs.select("pair_id"), "pair_id", "left_anti")
    conflict = lambda key: blocked.join(
        pairs.select(key), key, "left_semi").select(*shown)
    return Resolution(
        pairs.select(*shown), conflict("old_entity_key"), conflict("new_entity_key"),
        scored.where(~usable).select(*shown),
    )
