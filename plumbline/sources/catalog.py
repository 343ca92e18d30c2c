"""Catalogs of parameters, reference specifications and layer keywords, as users write them, in YAML or JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CATALOG = "entry_id long, name string, aliases array<string>, unit string, direction string, sheet_types array<string>, threshold double"
SPECS = "name string, spec_value double, tolerance double, direction string"
LAYERS = "group string, keywords array<string>, threshold int"


def _read(spark: SparkSession, path: str) -> dict:
    """The file as a dict. Such files are written by hand and small; JSON is read as YAML."""
    import yaml

    return yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {}


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, name, aliases, unit, direction, sheet_types and threshold of the entries under `parameters`; mm, ANY, no types and
    0.40 where these are absent."""
    rows = [
        (int(p["id"]), p["name"], list(p.get("aliases") or []), p.get("unit") or "mm", p.get("dimension_direction") or "ANY", list(p.get("relevant_sheet_types") or []), float(p.get("confidence_threshold", 0.40)))
        for p in _read(spark, path).get("parameters") or []
    ]
    return spark.createDataFrame(rows, CATALOG)


def specifications(spark: SparkSession, path: str) -> DataFrame:
    """name, spec_value, tolerance and direction (EXACT by default) of the entries under `spec_references`."""
    rows = [(s["parameter_name"], float(s["spec_value"]), float(s.get("tolerance") or 0), s.get("direction") or "EXACT") for s in _read(spark, path).get("spec_references") or []]
    return spark.createDataFrame(rows, SPECS)


def layers(spark: SparkSession, path: str) -> DataFrame:
    """group, keywords and threshold (1 by default) of the entries under `layer_groups`."""
    rows = [(g, list(v.get("keywords") or []), int(v.get("threshold", 1))) for g, v in (_read(spark, path).get("layer_groups") or {}).items()]
    return spark.createDataFrame(rows, LAYERS)
