"""Recognisers as table functions: preflight, signatures, one load a task."""

import os

import pytest
from pyspark.sql.types import LongType, StringType, StructType

from cadenza.sources import recognise

SCHEMA = StructType().add("path", StringType()).add("seg", LongType()).add("text", StringType())


def maker(folder, actual="v1/cpu", broken=False):
    class Fake:
        def note(self, what):
            with open(os.path.join(folder, f"{what}-{os.getpid()}-{id(self)}"), "w"):
                pass

        def preflight(self):
            self.note("preflight")
            if broken:
                raise RuntimeError("no model")

        def expected(self):
            return "v1/cpu"

        def actual(self):
            return actual

        def load(self):
            self.note("load")

        def transcribe(self, row):
            return [(row["path"], k, w) for k, w in enumerate((row["said"] or "").split())]

        def unload(self):
            self.note("unload")

    return Fake


def noted(folder, what):
    return len([f for f in os.listdir(folder) if f.startswith(what)])


def test_rows_through_a_recogniser(spark, tmp_path):
    audio = spark.createDataFrame([(f"p{k}", "a b" if k else None) for k in range(20)], "path string, said string").repartition(3)
    function = recognise.table_function(maker(str(tmp_path)), SCHEMA)
    found = recognise.transcribed(spark, audio, function, "v1/cpu").collect()
    assert sorted(tuple(r) for r in found) == sorted((f"p{k}", i, x) for k in range(1, 20) for i, x in enumerate("ab"))
    assert noted(tmp_path, "preflight") >= 1 and 1 <= noted(tmp_path, "load") <= 3 and noted(tmp_path, "unload") == noted(tmp_path, "load")


def test_it_fails_before_any_task(spark, tmp_path):
    audio = spark.createDataFrame([("p", "a")], "path string, said string")
    with pytest.raises(Exception, match="no model"):
        recognise.transcribed(spark, audio, recognise.table_function(maker(str(tmp_path), broken=True), SCHEMA), name="broken")
    with pytest.raises(Exception, match="asked for v2"):
        recognise.transcribed(spark, audio, recognise.table_function(maker(str(tmp_path)), SCHEMA), "v2'/gpu", name="other")
    assert noted(tmp_path, "load") == 0


def test_loaded_runtime_is_compared(spark, tmp_path):
    audio = spark.createDataFrame([("p", "a")], "path string, said string")
    changed = maker(str(tmp_path), actual="v1/gpu")
    with pytest.raises(Exception, match="loaded v1/gpu"):
        recognise.transcribed(spark, audio, recognise.table_function(changed, SCHEMA), name="changed").collect()
    allowed = recognise.table_function(changed, SCHEMA, {"v1/cpu": "v1/gpu"})
    assert recognise.transcribed(spark, audio, allowed, name="allowed").count() == 1
