"""Alignment of new tables to the columns a model was fitted on, as a pipeline stage
(PRJ13, PRJ14, PRJ18).

``ColumnAlignment`` learns a training table's columns: their types, which are yes / no text,
and the levels of text.  The fitted ``ColumnAligner`` gives any table those columns in
their order, so it stands first in a pipeline, is saved and loaded with it, and works on
batches and streams alike.

Defined cases: a missing column is 0 (numbers, flags) or "Unknown" (text); further columns go,
but for the carried ones; text is trimmed and its blanks become "_"; a text that no training
row had becomes "Unknown", as null does; a flag's text that is neither yes nor no, and what
is no finite number in a number's column, is 0; a carried column that is missing is null.
"""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite_or_null, q
from .features import BINARY_MAP, UNKNOWN, level_table, standardize_text
from .quality import binary_remap_columns, numeric_view
from .schema import is_numeric_type

NUMBER, FLAG, TEXT = "number", "flag", "text"


def clean_text(df: DataFrame, name: str) -> Column:
    return standardize_text(q(name).cast("string"))


class ColumnAligner(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Gives a table the fitted columns.  ``columns`` is JSON: name, kind, type and, for text,
    levels (null: any text is kept)."""

    columns = Param(Params._dummy(), "columns", "fitted columns as JSON", TypeConverters.toString)
    carried = Param(Params._dummy(), "carried", "columns passed on, as JSON: name and type",
                    TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns: str = "[]", carried: str = "[]"):
        super().__init__()
        self._setDefault(columns="[]", carried="[]")
        self._set(columns=columns, carried=carried)

    def fitted(self) -> list[dict]:
        return json.loads(self.getOrDefault(self.columns))

    def _value(self, df: DataFrame, c: dict) -> Column:
        name, kind = c["name"], c["kind"]
        if name not in df.columns:
            return F.lit(UNKNOWN) if kind == TEXT else F.lit(0).cast(c["type"])
        if kind == NUMBER:
            return F.coalesce(finite_or_null(numeric_view(df, name)).try_cast(c["type"]), F.lit(0).cast(c["type"]))
        if kind == FLAG:
            mapping = F.create_map(*[F.lit(x) for k, v in BINARY_MAP.items() for x in (k, v)])
            return F.coalesce(mapping[F.lower(F.trim(q(name).cast("string")))], F.lit(0)).cast(c["type"])
        text = F.coalesce(clean_text(df, name), F.lit(UNKNOWN))
        return text if c["levels"] is None else F.when(text.isin(c["levels"]), text).otherwise(UNKNOWN)

    def _transform(self, df: DataFrame) -> DataFrame:
        fitted = self.fitted()
        names = {c["name"] for c in fitted}
        passed = [(q(c["name"]) if c["name"] in df.columns else F.lit(None).cast(c["type"])).alias(c["name"])
                  for c in json.loads(self.getOrDefault(self.carried)) if c["name"] not in names]
        return df.select(*passed, *[self._value(df, c).alias(c["name"]) for c in fitted])


class ColumnAlignment(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Learns ``inputCols`` of a training table.  Text with more than ``maxLevels`` levels is kept
    as it is, so what reaches the driver is bounded."""

    inputCols = Param(Params._dummy(), "inputCols", "model columns", TypeConverters.toListString)
    carried = Param(Params._dummy(), "carried", "columns passed on", TypeConverters.toListString)
    maxLevels = Param(Params._dummy(), "maxLevels", "most levels kept of a text column",
                      TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCols: list[str] = (), carried: list[str] = (), maxLevels: int = 1000):
        super().__init__()
        self._setDefault(inputCols=[], carried=[], maxLevels=1000)
        self._set(inputCols=list(inputCols), carried=list(carried), maxLevels=maxLevels)

    def _fit(self, df: DataFrame) -> ColumnAligner:
        cols = self.getOrDefault(self.inputCols)
        limit = self.getOrDefault(self.maxLevels)
        text = [c for c in cols if not is_numeric_type(df.schema[c].dataType)]
        flags = set(binary_remap_columns(df.select(*[q(c) for c in text]), text, BINARY_MAP)) if text else set()
        plain = [c for c in text if c not in flags]
        levels: dict[str, list[str] | None] = {c: [] for c in plain}
        if plain:
            table = level_table(df.select(*[clean_text(df, c).alias(c) for c in plain]), plain)
            few = table.where(F.col("code") <= limit)         # one more than is kept, at most
            for r in few.orderBy("column_name", "code").collect():
                levels[r["column_name"]].append(r["level"])
            levels = {c: v if len(v) <= limit else None for c, v in levels.items()}

        def describe(c: str) -> dict:
            kind = FLAG if c in flags else TEXT if c in text else NUMBER
            stated = df.schema[c].dataType.simpleString()
            return {"name": c, "kind": kind, "type": {FLAG: "int", TEXT: "string"}.get(kind, stated),
                    "levels": levels.get(c)}

        passed = [{"name": c, "type": df.schema[c].dataType.simpleString()}
                  for c in self.getOrDefault(self.carried)]
        return ColumnAligner(columns=json.dumps([describe(c) for c in cols]), carried=json.dumps(passed))
