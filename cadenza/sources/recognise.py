"""Recognisers as table functions: checked before a query runs, loaded once a task, unloaded at its end.

A recogniser is a class of the caller's, with ``preflight()`` (raises if it can't run), ``expected()`` and ``actual()`` (runtime
signatures, before and after the model is loaded), ``load()``, ``transcribe(row)`` (rows of the schema) and ``unload()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


class RuntimeChanged(Exception):
    """The runtime is not the one whose results the caller has."""


def table_function(make, schema: StructType, fixed: dict[str, str] | None = None):
    """A table function of rows, and of a runtime signature or null, over recognisers that ``make()`` gives.

    Its analysis runs the preflight and compares the expected signature with the one asked for, so that a query that can't go on fails
    before any task. ``fixed`` names signatures that tasks must find once the model is loaded, by the expected one.
    """

    class Recognise:
        def __init__(self):
            self.model = None

        @staticmethod
        def analyze(rows: AnalyzeArgument, signature: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("the first argument is a table")
            model = make()
            model.preflight()
            expected = model.expected()
            if signature.value is not None and signature.value != expected:
                raise RuntimeChanged(f"asked for {signature.value}, found {expected}")
            return AnalyzeResult(schema=schema)

        def _ready(self):
            if self.model is None:
                self.model = make()
                self.model.load()
                wanted = (fixed or {}).get(self.model.expected(), self.model.expected())
                if self.model.actual() != wanted:
                    raise RuntimeChanged(f"expected {wanted}, loaded {self.model.actual()}")
            return self.model

        def eval(self, rows, signature):
            yield from self._ready().transcribe(rows)

        def terminate(self):
            if self.model is not None:
                self.model.unload()

    return udtf(Recognise)


def transcribed(spark: SparkSession, audio: DataFrame, function, signature: str | None = None, name: str = "recognise") -> DataFrame:
    """Rows of ``audio`` through a table function."""
    spark.udtf.register(name, function)
    view = f"_{name}_input"
    audio.createOrReplaceTempView(view)
    asked = "cast(null as string)" if signature is None else "'" + signature.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql(f"SELECT * FROM {name}(TABLE({view}), {asked})")
