"""FeatureTable: one DataFrame that holds the training and the scoring rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.spec import CATEGORICAL, NUMERIC, SchemaSpec

TRAIN = "train"
TEST = "test"


@dataclass(frozen=True)
class FeatureTable:
    """Rows of both splits, told apart by ``spec.split``; the target is null on test rows.

    Rows are identified by (split, id) and never by position.  Every operator returns a new
    table; ``inverse`` collects the functions that take a prediction back to target units.
    """

    df: DataFrame
    spec: SchemaSpec
    inverse: tuple[Callable[[Column], Column], ...] = ()

    @classmethod
    def from_pair(cls, train: DataFrame, test: DataFrame | None, spec: SchemaSpec) -> FeatureTable:
        df = train.withColumn(spec.split, F.lit(TRAIN))
        if test is not None:
            tagged = test.withColumn(spec.split, F.lit(TEST))
            df = df.unionByName(tagged, allowMissingColumns=True)
        return cls(df, spec).typed()

    def typed(self) -> FeatureTable:
        """Cast declared columns: NUMERIC to double, CATEGORICAL to string; nulls stay null."""
        have = dict(self.df.dtypes)
        casts = {}
        for c, s in self.spec.columns.items():
            want = "double" if s.type == NUMERIC else "string"
            if c in have and c != self.spec.id and have[c] != want:
                casts[c] = F.col(c).try_cast(want)
        return self.with_df(self.df.withColumns(casts) if casts else self.df)

    @property
    def train(self) -> DataFrame:
        return self.df.where(F.col(self.spec.split) == TRAIN)

    @property
    def test(self) -> DataFrame:
        return self.df.where(F.col(self.spec.split) == TEST)

    @property
    def features(self) -> list[str]:
        present = set(self.df.columns)
        return [c for c in self.spec.names() if c in present]

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.features if self.spec[c].type == NUMERIC]

    @property
    def categorical(self) -> list[str]:
        return [c for c in self.features if self.spec[c].type == CATEGORICAL]

    def with_df(self, df: DataFrame) -> FeatureTable:
        return replace(self, df=df)

    def with_spec(self, spec: SchemaSpec) -> FeatureTable:
        return replace(self, spec=spec)

    def with_columns(self, columns: dict[str, Column]) -> FeatureTable:
        return self.with_df(self.df.withColumns(columns))

    def with_numeric(self, columns: dict[str, Column]) -> FeatureTable:
        """Set columns and declare them NUMERIC."""
        return replace(
            self, df=self.df.withColumns(columns), spec=self.spec.with_numeric(columns)
        )

    def materialized(self) -> FeatureTable:
        """Write the table to shared storage once, for flows that pass over it several times."""
        from plumbline.plans.storage import materialize

        return self.with_df(materialize(self.df))

    def pipe(self, fn: Callable, *args, **kwargs):
        return fn(self, *args, **kwargs)

    def transform(self, fn: Callable[[DataFrame], DataFrame]) -> FeatureTable:
        """Apply a DataFrame function to the rows of both splits at once."""
        return self.with_df(self.df.transform(fn))

    def untransform(self, prediction: Column) -> Column:
        """Undo the target transforms, last one first."""
        for fn in reversed(self.inverse):
            prediction = fn(prediction)
        return prediction
