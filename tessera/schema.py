"""Named schemas: ordered fields with types, fixed when a relation is declared."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.types import FieldType, field_type


@dataclass(frozen=True)
class Schema:
    name: str
    fields: tuple[tuple[str, FieldType], ...]

    @classmethod
    def of(cls, name: str, fields: Iterable[tuple[str, str | FieldType]]) -> Schema:
        made = tuple((field, field_type(kind)) for field, kind in fields)
        if len({field for field, _ in made}) < len(made):
            raise ValueError(f"{name} has a field twice")
        return cls(name, made)

    @property
    def names(self) -> list[str]:
        return [field for field, _ in self.fields]

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(field, kind.spark, True) for field, kind in self.fields])

    def match(self, other: Schema) -> bool:
        """The same fields and types in the same order; names of the relations don't count."""
        return self.fields == other.fields

    def rename(self, name: str, names: Mapping[str, str]) -> Schema:
        """A schema with other field names; every field must be in the map."""
        if set(names) != set(self.names):
            raise ValueError("a rename must name every field")
        return Schema.of(name, ((names[field], kind) for field, kind in self.fields))

    def project(self, name: str, fields: Iterable[str]) -> Schema:
        kinds = dict(self.fields)
        return Schema.of(name, ((field, kinds[field]) for field in fields))

    def concat(self, name: str, other: Schema) -> Schema:
        """The fields of both, which must not share a name."""
        if shared := set(self.names) & set(other.names):
            raise ValueError(f"both sides have {sorted(shared)}")
        return Schema(name, self.fields + other.fields)

    def default_row(self) -> tuple:
        return tuple(kind.default for _, kind in self.fields)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "fields": [[field, str(kind)] for field, kind in self.fields]})

    @classmethod
    def from_json(cls, text: str) -> Schema:
        found = json.loads(text)
        return cls.of(found["name"], found["fields"])

    def fit(self, df: DataFrame) -> DataFrame:
        """df's columns of these names, as these types."""
        return df.select(*(kind.fit(F.col(field)).alias(field) for field, kind in self.fields))
