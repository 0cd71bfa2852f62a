"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

``fit_toxicity`` learns from a bounded sample of labelled rows (``SAMPLE`` of each label, the only bound), each with its
whole text; tasks count the rows of each feature by label, and the driver gets features of ``MIN_ROWS`` rows or more
whose shares of the two labels' rows differ by ``LEAST_Z`` standard errors (others have gradients too small for L1). L1 leaves
few weights, which every task gets as one array of 2^BITS floats (4 MB, whatever the corpus). ``score_toxicity`` scores
whole texts of any length.

Defined results: a null or empty text scores by the bias alone; repeated rows are scored one by one; an empty table
gives no rows; with no labelled rows or one label only, the model is the constant prior (0 with no rows). Input columns other
than the text are carried through; one named ``score`` or ``predicted`` becomes ``score_input`` or ``predicted_input``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import ftrl
from foliant.llm.columns import each, set_aside
from foliant.llm.features import WordHashes, word_gram_buckets
from foliant.llm.sampling import bounded_sample
from foliant.session import cut_lineage

BITS = 20
#: Labelled rows of each label to learn from.
SAMPLE = 4_000
#: A feature in fewer training rows than this gets no weight.
MIN_ROWS = 3
#: Standard errors by which a feature's shares of the two labels' rows differ, at least.
LEAST_Z = 1.5
THRESHOLD = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, np.float32)
        w[self.index] = self.weight
        return w


def _row(text: str, cache: WordHashes) -> np.ndarray:
    return np.unique(word_gram_buckets(text, BITS, cache))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        rows = [_row(t or "", cache).astype(np.int32) for t in each(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "label", "features"]
        )


def _rows_with(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of rows by bucket, of label 0 and of label 1."""
    table = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        label = batch.column("label").to_numpy(zero_copy_only=False)
        of_row = np.repeat(label, pc.list_value_length(batch.column("features")).to_numpy(zero_copy_only=False))
        buckets = batch.column("features").flatten().to_numpy(zero_copy_only=False)
        for k in (0, 1):
            table[k] += np.bincount(buckets[of_row == k], minlength=1 << BITS)
    buckets = np.flatnonzero(table.sum(axis=0))
    for at in range(0, len(buckets), 1 << 18):
        b = buckets[at : at + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(table[0, b]), pa.array(table[1, b])], ["bucket", "n0", "n1"])


def fit_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> ToxicityModel:
    """``docs``: doc_id, text. ``labels``: doc_id, label (0 or 1; null rows are ignored). The caller leaves out held-out rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label"))
    known = cut_lineage(known.groupBy("doc_id").agg(F.max("label").alias("label")))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    chosen = bounded_sample(known, "label", sample)
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    layout = "doc_id long, label int, features array<int>"
    featured = cut_lineage(train.mapInArrow(_featurise, layout))
    drawn = {r["label"]: r["count"] for r in featured.groupBy("label").count().collect()}
    frequent = np.zeros(1 << BITS, bool)
    if len(drawn) == 2:
        counted = featured.select("label", "features").mapInArrow(_rows_with, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        both, rows_in_all = F.col("n0") + F.col("n1"), drawn[0] + drawn[1]
        spread = F.sqrt(both / rows_in_all * (1 - both / rows_in_all) * (1 / drawn[0] + 1 / drawn[1]))
        apart = F.abs(F.col("n1") / drawn[1] - F.col("n0") / drawn[0])
        telling = counted.where((both >= MIN_ROWS) & (apart >= LEAST_Z * spread)).select("bucket")  # 2^BITS rows at most
        frequent[telling.toArrow().column(0).to_numpy()] = True

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [own[frequent[own]] for own in (np.asarray(x, np.int32) for x in batch.column("features").to_numpy(zero_copy_only=False))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(rows, pa.list_(pa.int32()))], batch.schema.names)

    found = featured.mapInArrow(keep, layout).toArrow()
    order = np.lexsort((found.column("doc_id").to_numpy(),))
    y = found.column("label").to_numpy()[order]
    if len(set(y.tolist())) < 2:
        prior = float(np.clip(y.mean(), 1e-6, 1 - 1e-6)) if len(y) else 1e-6
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))
    feats = [own for chunk in found.column("features").chunks for own in chunk.to_numpy(zero_copy_only=False)]
    ones = np.ones(max(map(len, feats)))
    rows = [(feats[i], ones[: len(feats[i])]) for i in order]
    w, b = ftrl.fit_binary(rows, y, 1 << BITS, alpha=1.0, l1=8.0, l2=0.1, epochs=6)
    # The sample is balanced by label; the bias moves to the shares among all labelled rows.
    b += float(np.log((counts[1] / np.sum(y == 1)) / (counts[0] / np.sum(y == 0))))
    index = np.flatnonzero(w)
    return ToxicityModel(index, w[index].astype(np.float32), float(b))


def score_toxicity(df: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The other columns with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on)."""
    df = set_aside(df, ("score", "predicted", "_text"), keep=(text,))
    names = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, cache = model.dense(), WordHashes()
        for batch in batches:
            scores = []
            for place in range(batch.num_rows):
                hit = word_gram_buckets(batch.column(-1)[place].as_py() or "", BITS, cache)
                hit = np.unique(hit[dense[hit] != 0])
                scores.append(float(dense[hit].sum(dtype=np.float64)) + model.bias)
            p = 1.0 / (1.0 + np.exp(-np.clip(np.array(scores, np.float64), -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], [*names, "score"])

    picked = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_text"))
    return picked.mapInArrow(run, schema).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
