"""Token counts by source, language and tokenizer version, kept up to date by signed changes.

Changes are rows (kind, source, lang, version, tokens, old_tokens): an insert adds a document and its tokens, a delete takes both away, a revised
count adds the difference. A batch is summed up to one row per key before it is written under its own name, so committing it again
changes nothing, and totals are the sum over committed batches. Nothing is ever counted twice or recounted.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm.common import stored, text_or_empty
from panelwright.llm.tokens import default_tokenizer, encoder

KEY = ("source", "lang", "version")
DELTA = "source string, lang string, version string, docs bigint, tokens bigint"


# --- the table --------------------------------------------------------------------------------

def signed(changes: DataFrame) -> DataFrame:
    """One row per key with the signed sums of a batch of changes. Sums are combined before the shuffle, so a source with most rows is added up where its rows are.

    An unknown kind is refused; a null count is 0; null keys are keys of their own.
    """
    tokens, old = F.coalesce("tokens", F.lit(0)), F.coalesce("old_tokens", F.lit(0))
    wrong = F.raise_error(F.concat(F.lit("unknown kind of change: "), F.coalesce("kind", F.lit("null"))))
    docs = F.when(F.col("kind") == "insert", 1).when(F.col("kind") == "delete", -1).when(F.col("kind") == "revise", 0).otherwise(wrong.cast("int"))
    count = F.when(F.col("kind") == "insert", tokens).when(F.col("kind") == "delete", -tokens).otherwise(tokens - old)
    return changes.select(*KEY, docs.cast("bigint").alias("docs"), count.cast("bigint").alias("tokens")).groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))


class CountTable:
    """A folder with one sub-folder of summed changes per batch; a batch counts once its success marker exists."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Names of complete batches, in order."""
        path, fs = self._path(self.folder)
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()]
        return sorted(n for n in names if fs.exists(self._path(f"{self.folder}/{n}/_SUCCESS")[0]))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch; False, and nothing changes, if it is there already. A half-written batch is written anew."""
        if batch in self.committed():
            return False
        signed(changes).write.mode("overwrite").parquet(f"{self.folder}/{batch}")
        return True

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens) over committed batches; keys without documents and tokens are left out."""
        names = self.committed()
        if not names:
            return self.spark.createDataFrame([], DELTA)
        rows = self.spark.read.schema(DELTA).parquet(*[f"{self.folder}/{n}" for n in names])
        sums = rows.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.where("docs <> 0 or tokens <> 0")


# --- counts of documents ----------------------------------------------------------------------

def without_repeated_lines(text: str) -> str:
    return "\n".join(dict.fromkeys(text.split("\n")))


def _count(path: str):
    def run(batches):
        packed = encoder(path).packed
        for batch in batches:
            whole, revised = [], []
            for at in range(0, batch.num_rows, 256):
                texts = batch.column("_text").slice(at, 256).to_pylist()
                own = [len(x) // 4 for x in packed(texts)]
                less = [without_repeated_lines(t) for t in texts]
                other = [i for i, (a, b) in enumerate(zip(texts, less)) if a != b]
                again = dict(zip(other, packed([less[i] for i in other])))
                whole += own
                revised += [len(again[i]) // 4 if i in again else own[i] for i in range(len(texts))]
            keep = [n for n in batch.schema.names if n != "_text"]
            columns = [*[batch.column(n) for n in keep], pa.array(whole, pa.int64()), pa.array(revised, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "tokens", "revised"])

    return run


def counted(documents: DataFrame, tokenizer: str | None = None, version: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, source, lang, version, key, tokens, revised): tokens of the text, and of the text without repeated lines; key is a digest of the text."""
    text = text_or_empty(text_col)
    df = documents.select(
        F.col(id_col).alias("_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"),
        F.lit(version).alias("version"), F.sha2(text, 256).alias("key"), text.alias("_text"),
    )
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")
    return df.mapInArrow(_count(tokenizer or default_tokenizer()), f"{kept}, tokens bigint, revised bigint")


def maintain(documents: DataFrame, table: CountTable, tokenizer: str | None = None, version: str = "byte_bpe_50k") -> DataFrame:
    """Three batches over all documents, each committed twice, and the totals after them: every document is inserted; copies of a document of smaller id are
    deleted; documents that stay are recounted without repeated lines.

    A null text counts as empty. Rows with the same id and text are copies of each other but for one. Null sources and languages are keys of their own.
    No documents, no rows.
    """
    each = stored(counted(documents, tokenizer, version).withColumn("_row", F.monotonically_increasing_id()), "token-counts")
    first = each.groupBy("key").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_row"))).alias("first"))
    kept = stored(first.select(F.col("first._row").alias("_row")), "first-copies")
    batches = {
        "0-load": each.select(*KEY, F.lit("insert").alias("kind"), "tokens", F.lit(None).cast("bigint").alias("old_tokens")),
        "1-copies": each.join(kept, "_row", "left_anti").select(*KEY, F.lit("delete").alias("kind"), "tokens", F.lit(None).cast("bigint").alias("old_tokens")),
        "2-lines": each.where("revised <> tokens").join(kept, "_row", "left_semi").select(*KEY, F.lit("revise").alias("kind"), F.col("revised").alias("tokens"), F.col("tokens").alias("old_tokens")),
    }
    for _ in range(2):
        for name, changes in batches.items():
            table.commit(name, changes)
    return table.totals()
