"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Labels are taken from a bounded sample of the labelled rows that are not held out (SAMPLE_ROWS). From it a lexicon of words and word beginnings
is learned that occur with toxic texts more often than chance allows, beside a fixed list of insults. Each text then has a few dense
numbers: lexicon densities, how many hits have a second-person word near, capitals, punctuation, digits and obfuscated
words. Features of the sample come from the lexicon of the other half of it, and the calibration from trees that were fitted on the other half, so
neither learns its own noise. All texts are scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.sizing import broadcast_if_small
from panelwright.llm.common import stored, text_or_empty

SAMPLE_ROWS = 20_000
LEXICON_TERMS = 5_000
TREES, DEPTH = 15, 3
PREDICT_FROM = 0.3
HELD_OUT = 2
NEAR = 5
MEMO_WORDS = 300_000

# Common insults, and second-person words of the four languages.
INSULTS = "idiot moron stupid dumb scum trash loser pathetic worthless disgusting clown fool imbecile jerk garbage ugly"
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted vosotros tus"

LOOKALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
EDGES = re.compile(r"^\W+|[\W_]+$")
INNER = re.compile(r"[^\W\d_]")
MARK = re.compile(r"[\W\d_]+")

FEATURES = ("log_words", "hits_log", "density", "insult_density", "weight", "top_weight", "near_you", "near_share", "capitals", "cries", "marks", "digits", "obfuscated")


def terms_of(word: str) -> list[str]:
    """What the lexicon knows a word by: the word, and its first four and five characters."""
    out = ["=" + word]
    if len(word) > 4:
        out.append("^" + word[:4])
    if len(word) > 5:
        out.append("^" + word[:5])
    return out


def plain_form(raw: str) -> tuple[str, bool]:
    """(the word without marks at its ends, lookalikes undone; whether that undid something)."""
    word = EDGES.sub("", raw.lower())
    if len(word) > 2 and MARK.search(word) and INNER.search(word):
        undone = MARK.sub("", word.translate(LOOKALIKE))
        return undone, undone != word and len(undone) > 2
    return word, False


class Reader:
    """Features of texts under one lexicon; the memo maps raw words to codes, since words repeat."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.insults, self.second = set(INSULTS.split()), set(SECOND_PERSON.split())
        self.memo: dict[str, int] = {}
        self.kinds = [(0.0, 0, 0, 0)]
        self.code = {self.kinds[0]: 0}

    def _kind(self, raw: str) -> int:
        word, undone = plain_form(raw)
        weights = [self.lexicon[t] for t in terms_of(word) if t in self.lexicon]
        kind = (max(weights, default=0.0), int(word in self.insults), int(word in self.second), int(undone))
        if kind not in self.code:
            self.code[kind] = len(self.kinds)
            self.kinds.append(kind)
        return self.code[kind]

    def features(self, text: str) -> list[float]:
        import numpy as np

        words = text.split()
        memo = self.memo
        try:
            codes = list(map(memo.__getitem__, words))
        except KeyError:
            if len(memo) > MEMO_WORDS:
                memo.clear()
            for w in set(words):
                if w not in memo:
                    memo[w] = self._kind(w)
            codes = list(map(memo.__getitem__, words))
            if len(memo) > 2 * MEMO_WORDS:
                memo.clear()
        n = max(1, len(words))
        hits = insults = near = obfuscated = 0
        weight = top = 0.0
        if any(codes):
            table = np.array(self.kinds)[np.array(codes, dtype=np.int64)]
            hit = (table[:, 0] > 0) | (table[:, 1] > 0)
            hits, insults, obfuscated = int(hit.sum()), int(table[:, 1].sum()), int(table[:, 3].sum())
            weight, top = float(table[:, 0].sum()), float(table[:, 0].max())
            if hits and table[:, 2].any():
                before = np.concatenate([[0.0], np.cumsum(table[:, 2])])
                at = np.flatnonzero(hit)
                near = int((before[np.minimum(at + NEAR + 1, len(codes))] > before[np.maximum(at - NEAR, 0)]).sum())
        raw = text.encode("utf-8", "surrogatepass")
        size = max(1, len(raw))
        capitals = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        marks = size - len(raw.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
        digits = size - len(raw.translate(None, b"0123456789"))
        if not raw:
            capitals = marks = digits = 0
        return [
            math.log1p(len(words)), math.log1p(hits), hits / n, insults / n, weight / n, top, near / n, near / max(1, hits),
            capitals / size, raw.count(b"!") / size, marks / size, digits / size, obfuscated / n,
        ]


# --- the sample -------------------------------------------------------------------------------

def remainder(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 4


def labelled_sample(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, rows: int) -> DataFrame:
    """Stored (_id, _text, label, half): about `rows` labelled documents that are not held out, chosen by a hash of the id."""
    known = labels.select(F.col(labels.columns[0]).alias("_id"), F.col(labels.columns[1]).alias("label")).where("_id is not null and label is not null")
    known = known.where(remainder(F.col("_id")) != HELD_OUT).groupBy("_id").agg(F.max("label").cast("double").alias("label"))
    known = stored(known, "labels")
    share = min(1.0, rows / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    half = F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2)).cast("int")
    texts = documents.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    return stored(texts.join(broadcast_if_small(chosen, 2 * rows), "_id").select("_id", "_text", "label", half.alias("half")), "label-sample")


def _count_terms(batches):
    for batch in batches:
        counts: dict = {}
        for text, label, half in zip(batch.column("_text"), batch.column("label").to_pylist(), batch.column("half").to_pylist()):
            found = set()
            for raw in set(text.as_py().split()):
                found.update(terms_of(plain_form(raw)[0]))
            for term in found:
                own = counts.setdefault((half, term), [0, 0])
                own[int(label > 0)] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([counts[k][0] for k in keys], pa.int64()), pa.array([counts[k][1] for k in keys], pa.int64())],
            names=["half", "term", "clean", "toxic"],
        )


def learn_lexicons(sample: DataFrame, terms: int) -> dict[int, dict[str, float]]:
    """Lexicons of half 0, half 1 and (2) both: term -> log ratio of its shares in toxic and clean texts.

    A term stays if chance would give its counts to less than one of all terms (Chernoff's bound); of more than `terms`, those least
    like chance.
    """
    totals = {r["half"]: (r["c"], r["t"]) for r in sample.groupBy("half").agg(F.sum(1 - F.col("label")).alias("c"), F.sum("label").alias("t")).collect()}
    halves = [totals.get(h, (0.0, 0.0)) for h in (0, 1)]
    counted = sample.select("_text", "label", "half").mapInArrow(_count_terms, "half int, term string, clean bigint, toxic bigint")
    by_term = counted.groupBy("term").agg(*[F.sum(F.when(F.col("half") == h, F.col(c)).otherwise(0)).alias(f"{c}{h}") for h in (0, 1) for c in ("clean", "toxic")])
    by_term = stored(by_term, "terms")
    every = by_term.count()
    out = {}
    for which, own in ((0, (0,)), (1, (1,)), (2, (0, 1))):
        c = sum((F.col(f"clean{h}") for h in own), F.lit(0)).cast("double")
        t = sum((F.col(f"toxic{h}") for h in own), F.lit(0)).cast("double")
        all_c, all_t = sum(halves[h][0] for h in own), sum(halves[h][1] for h in own)
        if not all_c or not all_t:
            out[which] = {}
            continue
        base = all_t / (all_c + all_t)
        share = t / (t + c)
        surprise = t * F.log(share / base) + F.when(c > 0, c * F.log((1 - share) / (1 - base))).otherwise(0.0)
        weight = F.log((t + 0.5) / (all_t + 1)) - F.log((c + 0.5) / (all_c + 1))
        found = by_term.where(t >= 2).where(share > base).select("term", weight.alias("w"), surprise.alias("s")).where(F.col("s") > math.log(max(every, 2)))
        out[which] = {r["term"]: r["w"] for r in found.orderBy(F.desc("s"), "term").limit(terms).collect()}
    return out


# --- model ------------------------------------------------------------------------------------

_READERS: dict = {}


def _featurize(key: str, sent, by_half: bool):
    def run(batches):
        for batch in batches:
            if key not in _READERS:
                _READERS.clear()
                _READERS[key] = {k: Reader(v) for k, v in sent.value.items()}
            readers = _READERS[key]
            halves = batch.column("half").to_pylist() if by_half else None
            rows = [readers[1 - halves[i] if by_half else 2].features(text.as_py()) for i, text in enumerate(batch.column("_text"))]
            names = [n for n in batch.schema.names if n != "_text"]
            features = pa.array(rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], features], names=[*names, "f"])

    return run


def _with_features(texts: DataFrame, lexicons: dict, by_half: bool) -> DataFrame:
    import uuid

    sent = texts.sparkSession.sparkContext.broadcast(lexicons)
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in texts.schema if f.name != "_text")
    rows = texts.mapInArrow(_featurize(uuid.uuid4().hex, sent, by_half), f"{kept}, f array<double>")
    return rows.withColumn("features", array_to_vector("f")).drop("f")


def _trees(rows: DataFrame):
    return GBTClassifier(labelCol="label", featuresCol="features", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=3, seed=1).fit(rows)


def _raw(model, rows: DataFrame) -> DataFrame:
    """rows with the trees' probability of toxic, as `p`."""
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def score_toxicity(
    documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, lexicon_terms: int = LEXICON_TERMS
) -> DataFrame:
    """A row per document: id, held_out, score (0 to 1), predicted. `labels` holds (id, toxic).

    A null text counts as empty and is scored like any other; repeated rows are scored each; a null id is not held out and never labelled. Of
    repeated labels the largest counts, null labels none. Without labels of both kinds every score is the share of toxic labels, or 0.
    Other columns are not looked at.
    """
    sample = labelled_sample(documents, labels, id_col, text_col, sample_rows)
    held = F.coalesce(remainder(F.col("_id")) == HELD_OUT, F.lit(False))
    texts = documents.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    kinds = {(r["half"], r["label"] > 0): r["count"] for r in sample.groupBy("half", "label").count().collect()}
    toxic, clean = sum(n for (_, t), n in kinds.items() if t), sum(n for (_, t), n in kinds.items() if not t)
    if not toxic or not clean:
        scored = texts.select("_id", F.lit(toxic / max(1, toxic + clean)).alias("score"))
    else:
        lexicons = learn_lexicons(sample, lexicon_terms)
        train = stored(_with_features(sample.select("_text", F.signum("label").alias("label"), "half"), lexicons, True), "label-features")
        model = _trees(train)
        if len(kinds) == 4:
            apart = [_raw(_trees(train.where(f"half = {1 - h}")), train.where(f"half = {h}")) for h in (0, 1)]
            calibration = apart[0].unionByName(apart[1])
        else:  # too few labels for two halves of both kinds
            calibration = _raw(model, train)
        isotonic = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="calibrated").fit(calibration.select("p", "label"))
        raw = _raw(model, _with_features(texts, lexicons, False))
        scored = isotonic.transform(raw).select("_id", F.least(F.greatest("calibrated", F.lit(0.0)), F.lit(1.0)).alias("score"))
    predicted = F.when(F.col("score") >= PREDICT_FROM, 1).otherwise(0)
    return scored.select(F.col("_id").alias(id_col), held.alias("held_out"), "score", predicted.alias("predicted"))
