"""Reading, writing and versioning tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Label and quantile threshold to the key of their staging data.
LABEL_KEYS = {
    ("internal_cases_opened_any_next_month", None): "anycase",
    ("internal_opens_any_next_month", None): "anyopen",
    ("internal_knocks_any_next_month", None): "anyknock",
    ("internal_cases_opened_per_unit_next_month_binary", 0.9): "casethresholdhigher",
    ("internal_cases_opened_per_unit_next_month_binary", 0.75): "casethresholdlower",
}
# Column type map of the bulk writer where the stored type differs: small whole numbers widen, nothing is narrowed.
STORED_TYPES = {"smallint": "int", "tinyint": "int", "float": "double"}


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table, or a Parquet folder when the name holds a slash."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_query(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """A SQL query with named parameters (:name)."""
    return spark.sql(text, args=parameters or None)


def stored_columns(df: DataFrame, types: Mapping[str, str] | None = None, default_to_text: bool = True) -> list[Column]:
    """Casts for a typed write: all text by default, else by type map; named columns override both.

    Empty text is null, as in the bulk copy.
    """
    types = dict(types or {})

    def cast(name: str, kind: str) -> Column:
        value = F.when(F.col(name) != "", F.col(name)) if kind == "string" else F.col(name)
        target = types.get(name) or ("string" if default_to_text else STORED_TYPES.get(kind, kind))
        return (value.try_cast(target) if kind == "string" and target != "string" else value.cast(target)).alias(name)

    return [cast(n, k) for n, k in df.dtypes]


def write_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
) -> None:
    """Write to a catalog table, or to a Parquet folder when the name holds a slash.

    sort_by orders rows inside each file, for row-group skipping; no global sort is made. Rows are rebalanced
    on the partition columns, so a date with a third of all rows is written by many tasks.
    """
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    if sort_by:
        df = df.sortWithinPartitions(*partition_by, *sort_by)
    writer = df.write.mode(mode).format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if "/" in name:
        writer.save(name)
    else:
        writer.saveAsTable(name)


def write_typed(df: DataFrame, name: str, types: Mapping[str, str] | None = None, default_to_text: bool = True) -> None:
    write_table(df.select(*stored_columns(df, types, default_to_text)), name)


def append_rows(df: DataFrame, name: str, partition_by: Sequence[str] = ("as_of_date",)) -> None:
    """Append result rows; predictions, importances and evaluations are partitioned by date."""
    write_table(df, name, "append", [c for c in partition_by if c in df.columns])


def table_exists(spark: SparkSession, name: str) -> bool:
    if "/" not in name:
        return spark.catalog.tableExists(name)
    try:
        spark.read.parquet(name)
        return True
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return False
        raise


def build_table(spark: SparkSession, name: str, build, rebuild: bool = False, partition_by: Sequence[str] = ()) -> DataFrame:
    """Build if absent, rebuild if told to, else leave; ``build`` is only called when rows are needed."""
    if rebuild or not table_exists(spark, name):
        write_table(build(), name, "overwrite", partition_by)
    return read_table(spark, name)


def replace_splits(df: DataFrame, name: str, split: str = "split_date") -> None:
    """Overwrite only the splits that df holds."""
    writer = df.hint("rebalance", split).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(split).parquet(name)


def available_splits(df: DataFrame, split: str = "split_date") -> DataFrame:
    """The split dates present, in order."""
    return df.select(split).distinct().orderBy(split)


def backup(df: DataFrame, path: str, form: str = "csv") -> None:
    if form == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif form == "parquet":
        df.write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"unknown backup form {form!r}")


def restore_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


# --- tables that change row by row: every change is a new version beside the old one -------------------


def write_version(df: DataFrame, folder: str, version: int) -> None:
    """Write a whole new version; readers move to it once its success marker, which is written last, is there."""
    df.write.mode("errorifexists").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{folder}/version={version}")


def complete_versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the versions with a success marker, in order: a listing of folder names, no file is read."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    top = fs_path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(top) if s.isDirectory()]
    found = [n for n in names if n.startswith("version=") and fs.exists(fs_path(f"{folder}/{n}/_SUCCESS"))]
    return sorted(int(n.removeprefix("version=")) for n in found)


def read_latest(spark: SparkSession, folder: str) -> tuple[DataFrame, int]:
    """The newest complete version and its number; a version that is still being written, or was left half written, is not seen."""
    versions = complete_versions(spark, folder)
    if not versions:
        raise FileNotFoundError(f"no complete version below {folder}")
    return spark.read.parquet(f"{folder}/version={versions[-1]}"), versions[-1]


def label_key(label: str, threshold: float | None = None) -> str:
    """Key of the staging data for a label; an unknown combination is an error."""
    for key in ((label, threshold), (label, None)):
        if key in LABEL_KEYS:
            return LABEL_KEYS[key]
    raise ValueError(f"no staging data for label {label!r} with threshold {threshold!r}")
