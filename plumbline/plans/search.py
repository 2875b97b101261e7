"""Search over (column, technique) variants.

All valid variants of all columns are encoded side by side once; one pass then gives the cross
products of every encoded column, and each candidate set is scored from a block of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import encode, numeric
from plumbline.operators.columns import retain_columns
from plumbline.plans.gram import Grams, Linear, fold_grams
from plumbline.plans.storage import SMALL_ROWS, materialize
from plumbline.spec import NUMERIC, safe_name
from plumbline.table import FeatureTable

# technique names; fixed values
NUMERIC_TECHNIQUES = (
    "none",
    "extract_0",
    "linearize_order_2",
    "extract_0_linearize_order_2",
    "linearize_order_3",
    "quantile_bin(5)",
    "quantile_bin(10)",
    "quantile_bin(20)",
)
CATEGORICAL_TECHNIQUES = ("one_hot", "label_encoding", "target_mean", "target_median")
FAIL_SCORE = 9999.0


class Variant(NamedTuple):
    column: str
    technique: str

    @property
    def name(self) -> str:
        return safe_name(f"{self.column}_{self.technique}").rstrip("_")


def bin_count(technique: str) -> int:
    """Number of bins of a binning technique, 0 for any other."""
    return int(technique[13:-1]) if technique.startswith("quantile_bin(") else 0


def all_variants(table: FeatureTable) -> list[Variant]:
    out = [Variant(c, t) for c in table.numeric for t in NUMERIC_TECHNIQUES]
    return out + [Variant(c, t) for c in table.categorical for t in CATEGORICAL_TECHNIQUES]


def variant_grid(profile: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """(column, technique) for every profiled column and the techniques of its type.

    ``profile`` has (column, type); columns listed in ``used`` are left out.
    """
    numbers = F.array(*map(F.lit, NUMERIC_TECHNIQUES))
    texts = F.array(*map(F.lit, CATEGORICAL_TECHNIQUES))
    techniques = F.when(F.col("type") == NUMERIC, numbers).otherwise(texts)
    if used is not None:
        profile = profile.join(used.select("column").distinct(), "column", "left_anti")
    return profile.select("column", F.explode(techniques).alias("technique"))


def valid_variants(table: FeatureTable, variants: Sequence[Variant], small=SMALL_ROWS):
    """Variants whose technique can be applied, judged from two batched passes."""
    columns = {v.column for v in variants}
    numbers = [c for c in table.numeric if c in columns]
    texts = [c for c in table.categorical if c in columns]
    y = F.col(table.spec.target)
    aggs = []
    for c in numbers:
        x = F.col(c)
        other = F.when(x != 0, x)
        aggs += [
            F.coalesce(F.min(x) < F.max(x), F.lit(False)).alias(f"spread__{c}"),
            F.coalesce(F.min(other) < F.max(other), F.lit(False)).alias(f"spread0__{c}"),
            (F.count_if(x == 0) > 0).alias(f"zero__{c}"),
            (F.coalesce(F.regr_slope(y, other), F.lit(0.0)) != 0).alias(f"slope__{c}"),
        ]
    for c in texts:
        code = encode.ordinal_code(F.col(c), table.spec[c].categories)
        aggs.append(F.coalesce(F.min(code) < F.max(code), F.lit(False)).alias(f"spread__{c}"))
        levels = table.spec[c].categories[1:]
        live = F.lit(False)
        for level in levels:
            hit = F.coalesce(F.col(c) == F.lit(level), F.lit(False)).cast("int")
            live = live | (F.max(hit) != F.min(hit))
        aggs.append(live.alias(f"live__{c}"))
    facts = table.train.agg(*aggs).first().asDict()
    bins = [(v.column, bin_count(v.technique)) for v in variants if bin_count(v.technique)]
    edges = numeric.fit_bin_edges(table, bins, small)

    def valid(v: Variant) -> bool:
        c, t = v
        if bin_count(t):
            return edges[c, bin_count(t)] is not None
        if t == "extract_0":
            return facts[f"zero__{c}"] and facts[f"slope__{c}"]
        if t == "extract_0_linearize_order_2":
            return facts[f"spread0__{c}"]
        if t.startswith("linearize"):
            return facts[f"spread__{c}"]
        if t == "label_encoding":
            return facts[f"spread__{c}"]
        if t == "one_hot":
            return facts[f"live__{c}"]
        return True

    return [v for v in variants if valid(v)]


@dataclass(frozen=True)
class Encoded:
    """All variants encoded next to each other, and their cross products per fold."""

    table: FeatureTable
    columns: dict[Variant, list[str]]
    grams: Grams

    def score(self, variants: Sequence[Variant], recipe: Linear) -> float:
        """Cross-validated RMSE on the scaled columns of a variant list."""
        if any(v not in self.columns for v in variants):
            return FAIL_SCORE
        cols = [c for v in variants for c in self.columns[v]]
        return scaled(self.grams.subset(cols)).cv_rmse(recipe)

    def scores(self, sets: Sequence[Sequence[Variant]], recipe: Linear) -> list[float]:
        """``score`` of many variant lists, fitted in tasks.

        The candidates are a table and the cross products go along as a broadcast: folds x width^2
        numbers, whatever the rows.  Fits are those of ``score``; they do
        not start from each other's coefficients, so the order of candidates changes nothing.
        """
        sets = [list(vs) for vs in sets]
        columns = [[c for v in vs for c in self.columns.get(v, ())] for vs in sets]
        out = [FAIL_SCORE] * len(sets)
        known = [i for i, vs in enumerate(sets) if all(v in self.columns for v in vs)]
        if not known:
            return out
        spark = self.table.df.sparkSession
        held = spark.sparkContext.broadcast(self.grams)

        def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part in batches:
                found = [
                    scaled(held.value.subset(list(c))).cv_rmse(recipe) for c in part["columns"]
                ]
                yield pd.DataFrame({"ordinal": part["ordinal"], "score": found})

        tasks = min(len(known), spark.sparkContext.defaultParallelism)
        rows = [(i, columns[i]) for i in known]
        asked = spark.createDataFrame(rows, "ordinal int, columns array<string>").repartition(tasks)
        for r in asked.mapInPandas(fit, "ordinal int, score double").collect():
            out[r["ordinal"]] = r["score"]
        held.destroy()
        return out

    def commit(self, variants: Sequence[Variant]) -> FeatureTable:
        """The table with only the encoded columns of the accepted variants."""
        return retain_columns(self.table, [c for v in variants for c in self.columns[v]])


def scaled(grams: Grams) -> Grams:
    """The statistics of the features divided by their standard deviation."""
    import numpy as np

    sd = grams.std()
    width = np.concatenate([[1.0], np.where(sd > 0, sd, 1.0), [1.0]])
    folds = {k: g / np.outer(width, width) for k, g in grams.folds.items()}
    return Grams(grams.features, grams.target, grams.shift / width[1:], folds)


# --- techniques: a family learns the constants of all its variants together
#
# Each takes a table and variants and returns {variant: {suffix: expression}}; a variant that does
# not apply is left out.


def _plain(table, variants, small):
    return {v: {"": F.col(v.column)} for v in variants}


def _extracted(table, variants, small):
    moved = numeric.fit_extract(table, [v.column for v in variants], 0)
    at = {v: moved.get(v.column) for v in variants}
    return {
        v: {"": F.when(F.col(v.column) == 0, F.lit(x)).otherwise(F.col(v.column))}
        for v, x in at.items()
        if x is not None
    }


ORDERS = {"linearize_order_2": 2, "linearize_order_3": 3}


def _lines(table, variants, small):
    columns = sorted({v.column for v in variants})
    fits = numeric.fit_polynomials(table, columns, tuple(sorted(set(ORDERS.values()))))
    found = {v: fits.get((v.column, ORDERS[v.technique])) for v in variants}
    return {v: {"": p.apply(F.col(v.column))} for v, p in found.items() if p is not None}


def _lines_beside_zero(table, variants, small):
    fits = numeric.fit_polynomials(table, [v.column for v in variants], (2,), skip=0)
    out = {}
    for v in variants:
        x, p = F.col(v.column), fits.get((v.column, 2))
        if p is not None:
            out[v] = {"": F.when(x == 0, x).otherwise(p.apply(x))}
    return out


def _bins(table, variants, small):
    wanted = {(v.column, bin_count(v.technique)): v for v in variants}
    edges = numeric.fit_bin_edges(table, list(wanted), small)
    return {
        v: {str(i): flag for i, flag in enumerate(numeric.bin_flags(F.col(v.column), edges[key]), 1)}
        for key, v in wanted.items()
        if edges[key] is not None
    }


def _flags(table, variants, small):
    hit = lambda c, level: F.coalesce(F.col(c) == F.lit(level), F.lit(False)).cast("int")
    return {
        v: {level: hit(v.column, level) for level in table.spec[v.column].categories[1:]}
        for v in variants
    }


def _codes(table, variants, small):
    return {
        v: {"": encode.ordinal_code(F.col(v.column), table.spec[v.column].categories)}
        for v in variants
    }


def _statistics(table, variants, small):
    """Also gives the table, to which statistics of columns with many categories are joined."""
    y = table.spec.target
    joined, stats = encode.stat_columns(table, sorted({v.column for v in variants}), small)
    defaults = {
        "target_mean": ("mean", table.train.agg(F.avg(y)).first()[0]),
        "target_median": ("median", numeric.column_quantiles(table.train, {y: [0.5]}, small)[y][0]),
    }
    made = {}
    for v in variants:
        stat, default = defaults[v.technique]
        made[v] = {"": F.coalesce(stats[v.column, stat], F.lit(default))}
    return joined, made


TECHNIQUES: dict[str, Callable] = {
    "none": _plain,
    "extract_0": _extracted,
    **dict.fromkeys(ORDERS, _lines),
    "extract_0_linearize_order_2": _lines_beside_zero,
    **{t: _bins for t in NUMERIC_TECHNIQUES if bin_count(t)},
    "one_hot": _flags,
    "label_encoding": _codes,
    **dict.fromkeys(("target_mean", "target_median"), _statistics),
}


def variant_table(
    table: FeatureTable, variants: Sequence[Variant], small: int = SMALL_ROWS
) -> tuple[FeatureTable, dict[Variant, dict[str, Column]]]:
    """The encoded columns of every applicable variant, as expressions on the table returned.

    Constants are learned per family of techniques for all columns together, so the number of
    passes does not grow with the number of columns.  The table is the given one, beside which
    statistics of columns with many categories are joined.
    """
    families: dict[Callable, list[Variant]] = {}
    for v in variants:
        families.setdefault(TECHNIQUES[v.technique], []).append(v)
    made, out = {}, table
    for family, members in families.items():
        found = family(table, members, small)
        if family is _statistics:
            out, found = found
        made |= found
    return out, {
        v: {safe_name(f"{v.name}_{x}") if x else v.name: e for x, e in made[v].items()}
        for v in variants
        if v in made
    }


def variant_columns(
    table: FeatureTable, variants: Sequence[Variant], small: int = SMALL_ROWS
) -> dict[Variant, dict[str, Column]]:
    """``variant_table`` for columns of few categories: expressions on the given table."""
    out, made = variant_table(table, variants, small)
    if out.df.columns != table.df.columns:
        raise ValueError("statistics of columns with many categories are joined: use variant_table")
    return made


def apply_variant(
    table: FeatureTable, variant: Variant, small: int = SMALL_ROWS
) -> tuple[FeatureTable, list[str]] | None:
    """The table with the variant's columns added, and their names; None if it does not apply."""
    joined, found = variant_table(table, [variant], small)
    made = found.get(variant)
    if not made:
        return None
    out = joined.with_numeric(made)
    extra = set(joined.df.columns) - set(table.df.columns) - set(made)
    return out.with_df(out.df.drop(*extra)), list(made)


def encode_variants(
    table: FeatureTable, variants: Sequence[Variant], fold: Column, small: int = SMALL_ROWS
) -> Encoded:
    """Encode every applicable variant into its own columns; nulls count as 0 after encoding."""
    source = table.with_df(materialize(table.df))
    source, made = variant_table(source, variants, small)
    spec = source.spec
    filled = {
        n: F.coalesce(e.cast("double"), F.lit(0.0)) for cols in made.values() for n, e in cols.items()
    }
    flat = source.df.select(
        *spec.keys, spec.target, *[e.alias(n) for n, e in filled.items()]
    )
    encoded = FeatureTable(materialize(flat), spec.only([]).with_numeric(filled))
    grams = fold_grams(encoded.train, list(filled), spec.target, fold)
    # columns that do not vary over the train rows carry nothing
    live = {c for c, sd in zip(grams.features, grams.std()) if sd > 0}
    columns = {v: [c for c in cols if c in live] for v, cols in made.items()}
    return Encoded(encoded, {v: cols for v, cols in columns.items() if cols}, grams)


# --- selection: a round is a table of all its candidates


def score_table(candidates: Sequence, scores: Sequence[float], goal: str = "min"):
    """(ordinal, candidate, score), best first; equal scores keep the order of the candidates."""
    out = pd.DataFrame({"ordinal": range(len(candidates)), "candidate": candidates, "score": scores})
    return out.sort_values(["score", "ordinal"], ascending=[goal == "min", True], ignore_index=True)


def selection_rounds(candidates: Callable[[list], Sequence], evaluate: Callable, goal: str = "min"):
    """Score tables of successive rounds, each on top of the winners before it.

    ``candidates`` gives what is open after the winners so far; ``evaluate`` scores a batch of
    candidate sets at once.
    """
    winners: list = []
    while len(offered := list(candidates(winners))):
        table = score_table(offered, evaluate([winners + [c] for c in offered]), goal)
        yield table
        winners.append(table.at[0, "candidate"])


def forward_select(
    candidates: Callable[[list], Sequence], evaluate: Callable, goal: str = "min", exhaust: bool = False
):
    """All rounds up to the first that does not improve on the best before it, as one table.

    Columns: round, ordinal, candidate, score, improved (of the round).  Within a round the winner
    comes first.  With ``exhaust`` rounds go on until no candidate is open.
    """
    rounds, reached = [], float("inf")
    for number, table in enumerate(selection_rounds(candidates, evaluate, goal), 1):
        top = table.at[0, "score"] * (1 if goal == "min" else -1)
        rounds.append(table.assign(round=number, improved=top < reached))
        if top >= reached and not exhaust:
            break
        reached = min(reached, top)
    columns = ["round", "ordinal", "candidate", "score", "improved"]
    return pd.concat(rounds, ignore_index=True)[columns] if rounds else pd.DataFrame(columns=columns)


def winners(history, improved_only: bool = True):
    """The winning row of every round, by default of those that improved."""
    first = history[~history.duplicated("round")]
    return first[first["improved"]] if improved_only else first


def unused_columns(variants: Sequence[Variant]) -> Callable[[list], list[Variant]]:
    """Candidates of a round: variants of columns that no chosen variant uses."""

    def candidates(chosen: list[Variant]) -> list[Variant]:
        used = {v.column for v in chosen}
        return [v for v in variants if v.column not in used]

    return candidates


def variant_scores(encoded: Encoded, recipe: Linear, baseline: float) -> DataFrame:
    """(column, technique, score, baseline) of each variant on its own."""
    found = encoded.scores([[v] for v in encoded.columns], recipe)
    rows = [
        (v.column, v.technique, score, baseline)
        for v, score in zip(encoded.columns, found, strict=True)
    ]
    return encoded.table.df.sparkSession.createDataFrame(
        rows, "column string, technique string, score double, baseline double"
    )
