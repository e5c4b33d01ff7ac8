"""Language of texts by a convolutional network over bytes: filters of several widths, the maximum of each over a window, and a softmax.

The network reads windows of WINDOW bytes; a whole text is cut into such windows (the last one filled with zeros), all of them are read in batches, and
the text's language is that of the largest mean log probability, weighted by bytes. It is trained in numpy on the driver, on a bounded sample: at most
ROWS_PER_LANG labelled rows of each language that are not held out, and PER_TEXT windows of each, chosen by a hash of id and text. Training
needs no more than the languages times 500 KB; texts are read where they lie, without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.common import stored, text_or_empty

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
ROWS_PER_LANG = 1_000
PER_TEXT = 2
EPOCHS, BATCH, RATE, DECAY = 6, 32, 0.01, 1e-4
HELD_OUT = 2
CHUNK = 128
UNDETERMINED = "und"


class ByteNet:
    """z[w] = sum of one table row per byte of the filter; max over the window, relu, softmax."""

    def __init__(self, classes: int, seed: int = 12):
        draw = np.random.default_rng(seed)
        self.tables = [draw.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = draw.normal(0, 0.1, (len(WIDTHS) * FILTERS, classes)).astype(np.float32)
        self.out_bias = np.zeros(classes, np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.tables, self.bias, self.out, self.out_bias]

    def _read(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Pooled values and where each maximum lies. x: a window a row."""
        pooled, places = [], []
        for w, table in zip(WIDTHS, self.tables):
            z = sum(table[j][x[:, j : x.shape[1] - w + 1 + j]] for j in range(w))
            at = z.argmax(axis=1)
            places.append(at)
            pooled.append(np.take_along_axis(z, at[:, None, :], axis=1)[:, 0])
        return np.concatenate(pooled, axis=1) + self.bias, places

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean cross entropy: only the bytes under a maximum get any."""
        pooled, places = self._read(x)
        hidden = np.maximum(pooled, 0)
        wrong = np.exp(log_softmax(hidden @ self.out + self.out_bias))
        wrong[np.arange(len(y)), y] -= 1
        wrong /= len(y)
        back = (wrong @ self.out.T) * (pooled > 0)
        grads, row = [], np.arange(len(x))[:, None]
        for k, (w, at) in enumerate(zip(WIDTHS, places)):
            own, grad = back[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(self.tables[k])
            for j in range(w):
                np.add.at(grad[j], (x[row, at + j], np.arange(FILTERS)[None, :]), own)
            grads.append(grad)
        return [*grads, back.sum(axis=0), hidden.T @ wrong, wrong.sum(axis=0)]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int, seed: int = 13) -> ByteNet:
        """Adam over shuffled batches; the rate falls to zero in a straight line."""
        draw = np.random.default_rng(seed)
        first, second = ([np.zeros_like(p) for p in self.parameters()] for _ in range(2))
        steps, t = epochs * -(-len(x) // BATCH), 0
        for _ in range(epochs):
            order = draw.permutation(len(x))
            for a in range(0, len(x), BATCH):
                own = order[a : a + BATCH]
                t += 1
                rate = RATE * (1 - (t - 1) / steps) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
                for p, g, m, v in zip(self.parameters(), self.gradients(x[own], y[own]), first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p -= (rate * (m / (np.sqrt(v) + 1e-8)) + rate * DECAY * p).astype(np.float32)
        return self


class Reader:
    """The trained network for many windows: two bytes are looked up at once."""

    def __init__(self, net: ByteNet):
        self.pairs = [[(t[j][:, None] + t[j + 1][None]).reshape(65_536, FILTERS) for j in range(0, len(t) - 1, 2)] for t in net.tables]
        self.single = [t[-1] if len(t) % 2 else None for t in net.tables]
        self.bias, self.out, self.out_bias = net.bias, net.out, net.out_bias

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        pooled = []
        for w, pairs, single in zip(WIDTHS, self.pairs, self.single):
            n = x.shape[1] - w + 1
            z = pairs[0].take(pair[:, :n], axis=0)
            for j, table in enumerate(pairs[1:], 1):
                z += table.take(pair[:, 2 * j : 2 * j + n], axis=0)
            if single is not None:
                z += single.take(x[:, w - 1 :], axis=0)
            pooled.append(z.max(axis=1))
        return log_softmax(np.maximum(np.concatenate(pooled, axis=1) + self.bias, 0) @ self.out + self.out_bias)


def log_softmax(scores: np.ndarray) -> np.ndarray:
    scores = scores - scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def as_windows(texts: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(t[:WINDOW].ljust(WINDOW, b"\0") for t in texts), np.uint8).reshape(-1, WINDOW)


# --- sample -----------------------------------------------------------------------------------

def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def training_windows(documents: DataFrame, id_col: str, text_col: str, lang_col: str, rows_per_lang: int) -> DataFrame:
    """(lang, windows) of at most rows_per_lang labelled rows of each language, none of them held out."""
    lang, raw = F.col(lang_col).cast("string"), text_or_empty(text_col).cast("binary")
    usable = documents.where(lang.isNotNull() & F.coalesce(remainder(F.col(id_col)) != HELD_OUT, F.lit(True)))
    counts = {r["lang"]: r["n"] for r in usable.groupBy(lang.alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return documents.sparkSession.createDataFrame([], "lang string, windows array<binary>")
    # A hash thins out languages with far more rows than needed, so that no task orders them all; the order then cuts exactly.
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 4.0 * rows_per_lang / n)))])
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    n = F.greatest(F.ceil(F.octet_length(raw) / F.lit(WINDOW)), F.lit(1))
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PER_TEXT - 1)), lambda j: F.floor(j * n / F.lit(PER_TEXT))))
    windows = F.transform(at, lambda k: F.substring(raw, (k * WINDOW + 1).cast("int"), F.lit(WINDOW)))
    rows = usable.where(has_letter(text_col)).withColumn("_lang", lang).withColumn("_key", key)
    rows = rows.where(F.pmod("_key", F.lit(1 << 20)) < F.try_element_at(share, F.col("_lang")) * (1 << 20))
    rows = rows.select(F.col("_lang").alias("lang"), F.col("_key").alias("key"), windows.alias("windows"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "windows"))
    return rows.withColumn("nth", nth).where(F.col("nth") <= rows_per_lang).orderBy("lang", "nth").select("lang", "windows")


def has_letter(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string").rlike(r"\p{L}"), F.lit(False))


def train(sample: DataFrame, epochs: int = EPOCHS) -> tuple[list[str], ByteNet | None]:
    """Languages in order, and the network; none for less than two languages."""
    x, y, langs = [], [], []
    for r in sample.collect():
        if not langs or langs[-1] != r["lang"]:
            langs.append(r["lang"])
        x += [bytes(w) for w in r["windows"]]
        y += [len(langs) - 1] * len(r["windows"])
    if len(langs) < 2:
        return langs, None
    return langs, ByteNet(len(langs)).fit(as_windows(x), np.array(y), epochs)


# --- prediction -------------------------------------------------------------------------------

def _windows_of(data: np.ndarray, begins: np.ndarray, sizes: np.ndarray):
    """Chunks of (text number, windows, bytes in each window); a text without bytes has none."""
    counts = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = begins[text] + nth * WINDOW
    left = np.minimum(sizes[text] - nth * WINDOW, WINDOW)
    offsets = np.arange(WINDOW)
    for a in range(0, len(text), CHUNK):
        own = slice(a, a + CHUNK)
        inside = offsets[None, :] < left[own, None]
        at = np.where(inside, start[own, None] + offsets[None, :], 0)
        yield text[own], np.where(inside, data[at], 0).astype(np.uint8), left[own]


_READERS: dict = {}


def _predict(sent, key: str, langs: list[str]):
    def run(batches):
        if key not in _READERS:
            _READERS.clear()
            _READERS[key] = Reader(sent.value)
        reader = _READERS[key]
        for batch in batches:
            raw = batch.column("raw").cast(pa.large_binary())
            offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
            data = np.frombuffer(raw.buffers()[2] or b"\0", np.uint8)
            sizes = np.diff(offsets)
            sums = np.zeros((len(raw), len(langs)))
            for text, windows, weight in _windows_of(data, offsets[:-1], sizes):
                np.add.at(sums, text, reader.log_probabilities(windows) * weight[:, None])
            p = np.exp(log_softmax(sums / np.maximum(sizes, 1)[:, None]))
            best = p.argmax(axis=1)
            names = [n for n in batch.schema.names if n != "raw"]
            found = [pa.array([langs[b] for b in best.tolist()], pa.string()), pa.array(p[np.arange(len(p)), best], pa.float64())]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], *found], names=[*names, "lang", "score"])

    return run


def identify_languages(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG, epochs: int = EPOCHS
) -> DataFrame:
    """A row per document: id, held_out, lang_pred, score (0 to 1).

    A null text or one without a letter is `und`, score 0; repeated rows are judged each; a null id is not held out. Null languages teach nothing. If the labelled
    rows know one language only, it is every text's, score 1; if they know none, every text is `und`. Other columns are not looked at.
    """
    import uuid

    spark = documents.sparkSession
    sample = stored(training_windows(documents, id_col, text_col, lang_col, rows_per_lang), "language-sample")
    langs, net = train(sample.orderBy("lang"), epochs)
    held = F.coalesce(remainder(F.col("id")) == HELD_OUT, F.lit(False))
    texts = documents.select(F.col(id_col).alias("id"), has_letter(text_col).alias("letters"), text_or_empty(text_col).cast("binary").alias("raw"))
    if net is None:
        read = texts.withColumn("lang", F.lit(langs[0] if langs else UNDETERMINED)).withColumn("score", F.lit(1.0 if langs else 0.0))
    else:
        kind = documents.schema[id_col].dataType.simpleString()
        read = texts.mapInArrow(_predict(spark.sparkContext.broadcast(net), uuid.uuid4().hex, langs), f"id {kind}, letters boolean, lang string, score double")
    return read.select(
        F.col("id").alias(id_col),
        held.alias("held_out"),
        F.when(F.col("letters"), F.col("lang")).otherwise(UNDETERMINED).alias("lang_pred"),
        F.when(F.col("letters"), F.least(F.col("score"), F.lit(1.0))).otherwise(0.0).alias("score"),
    )
