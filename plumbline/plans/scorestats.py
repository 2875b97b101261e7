"""Repeated scores over seeds and split strategies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.sampling import mix
from plumbline.plans.gram import Grams, Linear, fold_grams
from plumbline.table import FeatureTable

# row buckets that folds and test shares are put together from; shares are whole at 1 in 200
BUCKETS = 200


def bucket_grams(table: FeatureTable, features: Sequence[str], buckets: int = BUCKETS) -> Grams:
    """Cross products of many small row buckets, from which any folds can be put together."""
    bucket = F.pmod(mix(table.spec.id), F.lit(buckets))
    return fold_grams(table.train, features, table.spec.target, bucket)


def deal(buckets: Sequence[int], k: int, seed: int) -> dict[int, int]:
    """Seeded assignment of buckets to k folds of nearly equal bucket counts."""
    import random

    order = sorted(buckets)
    random.Random(seed).shuffle(order)
    return {b: i % k for i, b in enumerate(order)}


def test_split(buckets: Sequence[int], ratio: float, seed: int) -> dict[int, int]:
    """Seeded choice of the buckets that are tested on (1): their share is the nearest to ratio."""
    tested = round(ratio * len(buckets))
    return {b: int(place < tested) for b, place in deal(buckets, len(buckets), seed).items()}


def repeated_cv(grams: Grams, recipe: Linear, k: int, seeds: Sequence[int]) -> list[tuple]:
    """(seed, fold, score) rows; every seed deals the buckets into folds anew."""
    out = []
    for s in seeds:
        scores = grams.regroup(deal(list(grams.folds), k, s)).cv_scores(recipe)
        out += [(int(s), int(f), v) for f, v in scores.items()]
    return out


def strategy_sweep(
    table: FeatureTable,
    features: Sequence[str],
    recipe: Linear,
    folds: Sequence[int] = tuple(range(2, 13)),
    test_ratios: Sequence[float] = (),
    seeds: Sequence[int] = tuple(range(10)),
) -> DataFrame:
    """(strategy, seed, score): k-fold means and single-split scores, all from one pass."""
    grams = bucket_grams(table, features)
    rows = []
    for k in folds:
        for s in seeds:
            scores = [v for _, _, v in repeated_cv(grams, recipe, k, [s])]
            rows.append((f"{k}_folds", int(s), sum(scores) / len(scores)))
    for ratio in test_ratios:
        for s in seeds:
            parts = grams.regroup(test_split(list(grams.folds), ratio, s))
            model = parts.fit(recipe, without=1)
            rows.append((f"test_{ratio:g}", int(s), parts.rmse(model, 1)))
    schema = "strategy string, seed int, score double"
    return table.df.sparkSession.createDataFrame(rows, schema)
