"""Paged open data: pages of JSON rows at offsets 0, 10000, …, and the metadata that bounds them."""

from __future__ import annotations

import json
import os
import re
import time
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import (
    BooleanType,
    ByteType,
    DateType,
    DecimalType,
    IntegerType,
    LongType,
    ShortType,
    StringType,
    TimestampNTZType,
    TimestampType,
)

from panelwright.functions.scalars import resource_id

# Page size and the slack added to the row bound.
PAGE_ROWS = 10_000
BOUND_SLACK = 10_000
METADATA_SCHEMA = (
    "metadata struct<custom_fields: struct<`Update`: struct<`Update Frequency`: string>>>, "
    "columns array<struct<cachedContents: struct<cardinality: string>>>"
)
#: Times with all six digits; the JSON writer's default has three.
EXACT_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
CATALOG_SCHEMA = "dataname string, apilink string, include string, unique_id int, size_approx bigint"


def page_offsets(spark: SparkSession, limit: int, page: int = PAGE_ROWS) -> DataFrame:
    """Offsets 0, page, 2 * page, … below the limit."""
    return spark.range(0, limit, page).withColumnRenamed("id", "offset")


def parsed_metadata(text) -> Column:
    return F.from_json(F.col(text) if isinstance(text, str) else text, METADATA_SCHEMA)


def update_frequency(metadata: Column) -> Column:
    return metadata["metadata"]["custom_fields"]["Update"]["Update Frequency"]


def cardinality_bound(metadata: Column) -> Column:
    """Largest column cardinality plus slack; may exceed the row count, empty pages are fine."""
    sizes = F.transform(metadata["columns"], lambda c: c["cachedContents"]["cardinality"].try_cast("bigint"))
    return F.array_max(F.array_append(sizes, F.lit(0).cast("bigint"))) + F.lit(BOUND_SLACK)


def page_bound(metadata: Column, unique_id: Column, size_approx: Column) -> Column:
    """Row bound: from the cardinalities where a unique id exists, else from the stated size."""
    return F.when(unique_id == 1, cardinality_bound(metadata)).otherwise(size_approx + F.lit(BOUND_SLACK))


def source_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The list of sources: those with a link and marked for use, with their dataset id."""
    return usable_sources(spark.read.option("header", True).schema(CATALOG_SCHEMA).csv(path))


def usable_sources(sources: DataFrame) -> DataFrame:
    kept = sources.where((F.col("apilink") != "no") & (F.col("include") == "Yes"))
    return kept.withColumn("json_id", resource_id("apilink"))


def dataset_id(catalog: DataFrame, dataname: str) -> DataFrame:
    """The first id stored under a name."""
    return catalog.where(F.col("dataname") == dataname).select("json_id").limit(1)


def write_pages(rows: DataFrame, folder: str, page: int = PAGE_ROWS) -> None:
    """Write rows as JSON page files of at most ``page`` rows each, many per task: no shuffle, and no folder per page."""
    rows.write.mode("overwrite").options(maxRecordsPerFile=page, ignoreNullFields=False, **EXACT_TIMES).json(folder)


def read_pages(spark: SparkSession, folder: str, schema) -> DataFrame:
    """All pages of a folder with a stated schema: no inference pass, one scan over all files. An absent folder is an error."""
    return spark.read.schema(schema).options(**EXACT_TIMES).json(folder)


class PagedJson(DataSource):
    """``spark.read.format("paged_json")``: page files page_<offset>.json (rows as JSON lines), several per task.

    Options: path (a folder mounted on the driver and every executor), pages_per_task. All pages (*.json) that the folder holds are read, whatever
    bound they were fetched under; a folder or page that cannot be opened, in TRIES tries, is an error. Rows come as one Arrow batch a page in the types of
    the schema; a time without a zone is UTC. Comparisons of numbers, texts and flags with constants are applied to each page before its rows leave the
    reader. Executors need this package on their Python path. For pages in a layout that Spark reads, read_pages stays inside the JVM and is faster.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def reader(self, schema) -> DataSourceReader:
        return _PageReader(self.options, schema)


PAGE_FILE = re.compile(r"(?:page_(\d+)|[^_.].*)\.json")
TEXT_FIRST = (TimestampNTZType, DateType, DecimalType)
PLAIN = (BooleanType, ByteType, ShortType, IntegerType, LongType, StringType)
TRIES, WAIT = 3, 0.5
COMPARED = {EqualTo: "equal", GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal"}


def read_paged_json(spark: SparkSession, folder: str, schema, pages_per_task: int = 16) -> DataFrame:
    """The pages of a mounted folder through the paged_json source, with filters pushed into its reader."""
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").schema(schema).option("path", folder.removeprefix("file:")).option("pages_per_task", pages_per_task).load()


class _Pages(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class _PageReader(DataSourceReader):
    def __init__(self, options, schema):
        self.folder = options["path"]
        self.per_task = int(options.get("pages_per_task", 16))
        self.schema = schema
        self.kept: list = []

    def pushFilters(self, filters):
        """Comparisons with constants stay here; all others go back to Spark."""
        plain = {f.name for f in self.schema.fields if isinstance(f.dataType, PLAIN)}
        for f in filters:
            known = isinstance(f, (IsNotNull, In, *COMPARED)) and len(f.attribute) == 1 and f.attribute[0] in plain
            if known:
                self.kept.append(f)
            else:
                yield f

    def _filtered(self, batch):
        import pyarrow as pa
        import pyarrow.compute as pc

        for f in self.kept:
            column = batch.column(f.attribute[0])
            if isinstance(f, IsNotNull):
                keep = pc.is_valid(column)
            elif isinstance(f, In):
                keep = pc.and_(pc.is_in(column, pa.array([v for v in f.value if v is not None], column.type)), pc.is_valid(column))
            else:
                keep = getattr(pc, COMPARED[type(f)])(column, pa.scalar(f.value, column.type))
            batch = batch.filter(keep)
        return batch

    def _rows(self, name: str) -> list[dict]:
        for left in range(TRIES - 1, -1, -1):
            try:
                with open(os.path.join(self.folder, name)) as lines:
                    return [json.loads(line) for line in lines if line.strip()]
            except FileNotFoundError:
                raise
            except OSError:
                if not left:
                    raise
                time.sleep(WAIT)

    def partitions(self):
        found = sorted((int(m[1] or 0), m[0]) for m in map(PAGE_FILE.fullmatch, os.listdir(self.folder)) if m)
        files = [name for _, name in found]
        return [_Pages(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [_Pages([])]

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(self.schema)
        for name in partition.files:
            rows = self._rows(name)
            columns = []
            for field, kind in zip(self.schema.fields, types):
                values = [row.get(field.name) for row in rows]
                if isinstance(field.dataType, TimestampType):
                    times = [None if v is None else datetime.fromisoformat(v) for v in values]
                    columns.append(pa.array([t if t is None or t.tzinfo else t.replace(tzinfo=timezone.utc) for t in times], kind.type))
                elif isinstance(field.dataType, TEXT_FIRST):
                    # JSON has no dates and exact numbers: they arrive as text and are parsed into the stated type.
                    texts = [None if v is None else str(v) for v in values]
                    columns.append(pa.array(texts, pa.string()).cast(kind.type))
                else:
                    columns.append(pa.array(values, kind.type))
            yield self._filtered(pa.RecordBatch.from_arrays(columns, schema=types))
