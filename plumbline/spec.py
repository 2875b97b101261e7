"""Declared column types: the immutable companion of every feature table."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

NUMERIC = "NUMERIC"
CATEGORICAL = "CATEGORICAL"


def safe_name(name: str) -> str:
    """Column name that needs no quoting anywhere: only letters, digits and ``_``."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


@dataclass(frozen=True)
class ColumnSpec:
    type: str = NUMERIC
    categories: tuple[str, ...] = ()
    meaningful_order: bool = False
    possibly_categorical: bool = False
    possibly_numerical: bool = False

    def to_dict(self) -> dict:
        out: dict = {"type": self.type}
        if self.categories:
            out["categories"] = list(self.categories)
        for flag in ("meaningful_order", "possibly_categorical", "possibly_numerical"):
            if getattr(self, flag):
                out[flag] = True
        return out


@dataclass(frozen=True)
class SchemaSpec:
    """Id, target, split marker and per-column declarations.

    The order of ``categories`` is meaningful: it fixes ordinal codes and the level that
    one-hot encoding drops.
    """

    id: str
    target: str
    columns: Mapping[str, ColumnSpec] = field(default_factory=dict)
    split: str = "split"

    def names(self, type: str | None = None) -> list[str]:
        return [
            c
            for c, s in self.columns.items()
            if c not in (self.id, self.target, self.split) and (type is None or s.type == type)
        ]

    @property
    def numeric(self) -> list[str]:
        return self.names(NUMERIC)

    @property
    def categorical(self) -> list[str]:
        return self.names(CATEGORICAL)

    @property
    def keys(self) -> list[str]:
        return [self.split, self.id]

    def __getitem__(self, column: str) -> ColumnSpec:
        return self.columns[column]

    def with_column(self, name: str, spec: ColumnSpec | None = None) -> SchemaSpec:
        return replace(self, columns={**self.columns, name: spec or ColumnSpec()})

    def with_numeric(self, names: Iterable[str]) -> SchemaSpec:
        return replace(self, columns={**self.columns, **{n: ColumnSpec() for n in names}})

    def without(self, *names: str) -> SchemaSpec:
        return replace(self, columns={c: s for c, s in self.columns.items() if c not in names})

    def only(self, names: Iterable[str]) -> SchemaSpec:
        keep = set(names)
        return replace(self, columns={c: s for c, s in self.columns.items() if c in keep})

    def rename(self, mapping: Mapping[str, str]) -> SchemaSpec:
        return replace(
            self,
            id=mapping.get(self.id, self.id),
            target=mapping.get(self.target, self.target),
            columns={mapping.get(c, c): s for c, s in self.columns.items()},
        )

    def with_fill_level(self, column: str, value, position: int | None = None) -> SchemaSpec:
        """Declare the level used for filled nulls.

        A declared ``NA`` level is replaced in place.  Otherwise the level goes to ``position``,
        by default last, which for ordered levels makes it the highest code.
        """
        spec = self.columns[column]
        if not spec.categories or str(value) in spec.categories:
            return self
        levels = list(spec.categories)
        if "NA" in levels:
            levels[levels.index("NA")] = str(value)
        else:
            levels.insert(len(levels) if position is None else position, str(value))
        return self.with_column(column, replace(spec, categories=tuple(levels)))

    @classmethod
    def from_dict(cls, data: Mapping) -> SchemaSpec:
        columns = {}
        for name, raw in data.get("columns", {}).items():
            raw = dict(raw)
            # YAML readers turn bare words and numbers into other types; levels are text
            levels = tuple("NA" if v is None else str(v) for v in raw.pop("categories", ()))
            columns[name] = ColumnSpec(categories=levels, **raw)
        return cls(data["id"], data["target"], columns, data.get("split", "split"))

    @classmethod
    def from_yaml(cls, path: str) -> SchemaSpec:
        import yaml

        with open(path, encoding="utf-8") as f:
            # BaseLoader keeps every scalar as text, so `No` and `120` stay level names
            raw = yaml.load(f, Loader=yaml.BaseLoader)
        for col in raw["columns"].values():
            for flag in ("meaningful_order", "possibly_categorical", "possibly_numerical"):
                if flag in col:
                    col[flag] = str(col[flag]).lower() == "true"
        return cls.from_dict(raw)

    def to_dict(self) -> dict:
        return {
            "id": self.id,
            "target": self.target,
            "split": self.split,
            "columns": {c: s.to_dict() for c, s in self.columns.items()},
        }

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    @classmethod
    def from_json(cls, text: str) -> SchemaSpec:
        return cls.from_dict(json.loads(text))
