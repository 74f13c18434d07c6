"""Table, line and document readers."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallygrid.sources.xlsx import read_sheet


def suffix(path: str) -> str:
    return os.path.splitext(path.rstrip("/"))[1].lower()


def read_table(spark: SparkSession, path: str, text_columns: Sequence[str] = (), sheet: str | None = None) -> DataFrame:
    """A table by its suffix (S1, S2): csv, tsv, json, jsonl, parquet or xlsx.

    ``text_columns`` are read as text whatever they look like: long ids would lose digits as
    numbers. They are pinned before inference, not cast after it.
    """
    kind = suffix(path)
    if kind in (".csv", ".tsv"):
        reader = spark.read.option("header", True).option("sep", "\t" if kind == ".tsv" else ",").option("escape", '"').option("multiLine", True)
        if not text_columns:
            return reader.option("inferSchema", True).csv(path)
        inferred = reader.option("inferSchema", True).csv(path).schema
        return reader.schema(_pinned(inferred, text_columns)).csv(path)
    if kind in (".json", ".jsonl"):
        reader = spark.read.option("multiLine", kind == ".json")
        df = reader.json(path)
        return reader.schema(_pinned(df.schema, text_columns)).json(path) if text_columns else df
    if kind == ".parquet":
        df = spark.read.parquet(path)
        return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in text_columns else F.col(f"`{c}`") for c in df.columns])
    if kind in (".xlsx", ".xlsm"):
        return read_sheet(spark, path, sheet)
    raise ValueError(f"unknown table format: {path}")


def _pinned(schema: T.StructType, text_columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(f.name, T.StringType() if f.name in text_columns else f.dataType) for f in schema.fields])


def read_log(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV log as text columns, empty where there is none yet."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).option("escape", '"').schema(schema).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists in whatever store it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines; blank and corrupt ones are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_document(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Whole JSON documents, one per file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def uri_rows(documents: DataFrame) -> DataFrame:
    """Exploded ``subject``, ``path``, ``uri``, ``name``, ``key_id`` of URI map documents.

    The maps meet by hash: a look-up of each path would search a document once for each of its
    entries. Only a document that repeats a path is looked up, so that it keeps all its rows.
    """
    held = F.transform_values("uri_map", lambda path, uri: F.struct(uri.alias("uri")))
    both = F.map_zip_with(held, F.coalesce("name_map", F.create_map()), lambda path, held, name: F.struct(held.alias("held"), name.alias("name")))
    met = F.transform(F.map_entries(both), lambda e: F.struct(e["key"].alias("path"), e["value"]["held"].alias("held"), e["value"]["name"].alias("name")))
    searched = F.transform(F.map_entries("uri_map"), lambda e: F.struct(e["key"].alias("path"), F.struct(e["value"].alias("uri")).alias("held"), F.try_element_at("name_map", e["key"]).alias("name")))
    repeats = F.size(F.array_distinct(F.map_keys("uri_map"))) < F.size("uri_map")
    return documents.select("subject", F.explode(F.when(repeats, searched).otherwise(met)).alias("e"), "key_id").where("e.held IS NOT NULL").select(
        "subject", F.replace("e.path", F.lit("\\"), F.lit("/")).alias("path"), "e.held.uri", "e.name", "key_id")


def read_checkpoints(spark: SparkSession, pattern: str, format: str = "parquet") -> DataFrame:
    """All checkpoints of a glob with the name of their file (S7); ``_`` files are left out."""
    return spark.read.format(format).load(pattern).withColumn("checkpoint", F.col("_metadata.file_name"))


def read_text(spark: SparkSession, path: str) -> str:
    """A prompt file."""
    return spark.read.text(path, wholetext=True).first()[0]


def read_ids(spark: SparkSession, path: str, name: str = "subject") -> DataFrame:
    """Ids, one per line; blank lines are left out."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


@dataclass(frozen=True)
class PipelineConfig:
    """Settings of a model pipeline (S15): given values, then environment, then defaults."""

    input: str
    base_dir: str
    output_dir: str
    file_col: str = "file_path"
    group_col: str | None = None
    id_cols: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()
    model: str = ""
    extra: Mapping[str, object] = field(default_factory=dict)

    @classmethod
    def of(cls, given: Mapping[str, object], environment: Mapping[str, str] | None = None, prefix: str = "PIPELINE_") -> PipelineConfig:
        environment = os.environ if environment is None else environment
        names = [n for n in cls.__dataclass_fields__ if n != "extra"]
        values = {n: given[n] if n in given else environment[prefix + n.upper()] for n in names if n in given or prefix + n.upper() in environment}
        missing = [n for n in ("input", "base_dir", "output_dir") if not values.get(n)]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        for n in ("id_cols", "fields"):
            if n in values:
                values[n] = tuple(values[n].split(",") if isinstance(values[n], str) else values[n])
        return cls(**values, extra={k: v for k, v in given.items() if k not in names})
