"""Fit and transform over files that need not fit in memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.process import BinningPipeline

FORMATS = ("csv", "parquet")


def _format(path: str) -> str:
    kind = path.rstrip("/").rsplit(".", 1)[-1]
    if kind not in FORMATS:
        raise ValueError(f"files end in one of {FORMATS}")
    return kind


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, **options) -> DataFrame:
    """A csv (with header) or parquet file or folder; only ``columns`` are read."""
    kind = _format(path)
    reader = spark.read.options(**({"header": "true", "inferSchema": "true"} | options)) if kind == "csv" else spark.read.options(**options)
    df = reader.csv(path) if kind == "csv" else reader.parquet(path)
    return df.select(*columns) if columns else df


def read_column(spark: SparkSession, path: str, column: str, **options) -> DataFrame:
    return read_table(spark, path, [column], **options)


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    if _format(path) == "csv":
        df.write.mode(mode).option("header", "true").csv(path)
    else:
        df.write.mode(mode).parquet(path)


def fit_disk(spark: SparkSession, pipeline: BinningPipeline, path: str, target: str, **options) -> BinningPipeline:
    """Fit on the variables and target of a file, which is scanned for those columns alone."""
    return pipeline.fit(read_table(spark, path, [*pipeline.variable_names, target], **options), target)


def transform_disk(spark: SparkSession, pipeline: BinningPipeline, path: str, output: str, mode: str = "errorifexists", options: dict | None = None, **kwargs) -> None:
    """Encode a file into another one, in one distributed pass."""
    write_table(pipeline.transform(read_table(spark, path, list(pipeline.variable_names), **(options or {})), **kwargs), output, mode)


def fit_transform_disk(spark: SparkSession, pipeline: BinningPipeline, path: str, output: str, target: str, mode: str = "errorifexists", **kwargs) -> None:
    fit_disk(spark, pipeline, path, target)
    transform_disk(spark, pipeline, path, output, mode, **kwargs)
