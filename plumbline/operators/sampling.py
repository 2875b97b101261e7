"""Seeded shuffles, splits and folds, all functions of the row id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.plans.prefix import positions
from plumbline.plans.storage import SMALL_ROWS

# multiplicative mixing modulo a prime; ids are reduced first, so nothing overflows
MIX_FACTOR = 48_271
MIX_MODULUS = 2_147_483_647


def mix(id: str | Column, seed: int = 0) -> Column:
    """Well-spread integer in [0, MIX_MODULUS) of an integer id and a seed."""
    c = F.col(id) if isinstance(id, str) else id
    # two rounds, since one keeps neighbouring ids a constant step apart
    once = F.pmod((F.pmod(c, F.lit(MIX_MODULUS)) + F.lit(seed + 1)) * MIX_FACTOR, F.lit(MIX_MODULUS))
    low = F.pmod(once, F.lit(65_536))
    high = (once - low) / 65_536
    swapped = (low * 32_768 + high).cast("bigint")
    return F.pmod(swapped * MIX_FACTOR, F.lit(MIX_MODULUS))


def fraction(id: str | Column, seed: int = 0) -> Column:
    """The mixed id as a number in [0, 1)."""
    return mix(id, seed) / F.lit(float(MIX_MODULUS))


def hash_fold(id: str | Column, k: int, seed: int = 0) -> Column:
    """Fold number without any shuffle; fold sizes are equal on average."""
    return F.pmod(mix(id, seed), F.lit(k)).cast("int")


def hash_split(df: DataFrame, id: str, test_share: float, seed: int = 0) -> DataFrame:
    part = F.when(fraction(id, seed) < test_share, "test").otherwise("train")
    return df.withColumn("part", part)


def shuffle_rows(df: DataFrame, id: str, seed: int = 0, small: int = SMALL_ROWS) -> DataFrame:
    """Add ``pos``, the place of each row in a seeded permutation."""
    keyed = df.withColumn("__mix", mix(id, seed))
    return positions(keyed, [], ["__mix", id], "pos", small).drop("__mix")


def contiguous_folds(df: DataFrame, order: str, k: int, small: int = SMALL_ROWS) -> DataFrame:
    """Add ``fold``: k runs of consecutive rows, the first ``n % k`` one row longer."""
    n = df.count()
    size, longer = divmod(n, k)
    numbered = positions(df, [], [order], "__pos", small)
    pos = F.col("__pos")
    cut = longer * (size + 1)
    late = F.lit(longer) + F.floor((pos - cut) / F.lit(max(size, 1)))
    fold = F.when(pos < cut, F.floor(pos / F.lit(size + 1))).otherwise(late)
    return numbered.withColumn("fold", fold.cast("int")).drop("__pos")


def holdout(
    df: DataFrame, id: str, n: int, seed: int = 0, take_limit: int = 10_000, small: int = SMALL_ROWS
) -> DataFrame:
    """Add ``part``: the last n rows of the seeded permutation are ``holdout``, the rest ``train``.

    A short holdout needs only the n largest keys; a longer one ranks all rows.
    """
    if n > take_limit:
        total = df.count()
        ranked = shuffle_rows(df, id, seed, small)
        part = F.when(F.col("pos") >= total - n, "holdout").otherwise("train")
        return ranked.withColumn("part", part).drop("pos")
    key = F.struct(mix(id, seed).alias("m"), F.col(id).cast("bigint").alias("i"))
    last = df.select(key.alias("k")).orderBy(F.desc("k")).limit(n).agg(F.min("k").alias("k")).first()
    if last["k"] is None:
        return df.withColumn("part", F.lit("train"))
    m, i = F.lit(last["k"]["m"]), F.lit(last["k"]["i"])
    late = (mix(id, seed) > m) | ((mix(id, seed) == m) & (F.col(id) >= i))
    return df.withColumn("part", F.when(late, "holdout").otherwise("train"))


def percent_range(
    df: DataFrame, order: str, begin: float, end: float, small: int = SMALL_ROWS
) -> DataFrame:
    """Rows whose place in the order lies in [begin, end) percent; 0 to 100 keeps everything."""
    if begin == 0 and end == 100:
        return df
    n = df.count()
    numbered = positions(df, [], [order], "__pos", small)
    place = F.col("__pos") * F.lit(100.0) / F.lit(max(n, 1))
    return numbered.where((place >= begin) & (place < end)).drop("__pos")
