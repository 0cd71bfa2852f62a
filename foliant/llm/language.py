"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

``fit_language`` counts document frequencies over all training rows, per task first. It learns by
follow-the-regularised-leader with an elastic net from a bounded sample (``SAMPLE`` rows of each language, the only bound), then calibrates a temperature on a part of the sample that the fit did not see.
``predict_language`` reads whole texts of any length. The model has a fixed size, 2^BITS buckets times the languages.

Defined results: a text that is null or has no letter is ``und`` with score 0; repeated rows are predicted one by one;
an empty table gives no rows; with no usable training row every text is ``und``. Ties go to the first language by
name. Input columns other than the text are carried through; one named ``lang_pred`` or ``score`` becomes ``lang_pred_input``
or ``score_input``. Of repeated rows of an id and language, the least text teaches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm import ftrl
from foliant.llm.columns import each, set_aside
from foliant.llm.features import char_gram_counts, has_letter
from foliant.llm.sampling import bounded_sample

BITS = 15
ORDERS = (1, 2, 3)
#: Rows of each language to learn from.
SAMPLE = 500
#: One sample row in so many is kept for the temperature.
ASIDE = 5
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    idf: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        idx, val = _tfidf(*_counts(text), self.idf)
        s = (val @ self.weight[idx] + self.bias) / self.temperature
        p = np.exp(s - s.max())
        return p / p.sum()


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    counts = char_gram_counts(text, BITS, ORDERS)
    idx = np.flatnonzero(counts)
    return idx, counts[idx]


def _tfidf(idx: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    val = (1.0 + np.log(counts)) * idf[idx]
    norm = float(np.sqrt(val @ val))
    return idx, val / norm if norm else val


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [_counts(t) if t is not None and has_letter(t) else (np.zeros(0, np.int64),) * 2 for t in each(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("lang"),
                pa.array([i.astype(np.int32) for i, _ in rows], pa.list_(pa.int32())),
                pa.array([c.astype(np.int32) for _, c in rows], pa.list_(pa.int32())),
            ],
            ["doc_id", "lang", "idx", "counts"],
        )


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of texts by bucket; the last place has the number of texts."""
    table = np.zeros((1 << BITS) + 1, np.int64)
    for batch in batches:
        for t in each(batch.column(0)):
            if t is not None and has_letter(t):
                table[_counts(t)[0]] += 1
                table[-1] += 1
    buckets = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(buckets.astype(np.int32)), pa.array(table[buckets])], ["bucket", "n"])


def fit_language(docs: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """``docs``: doc_id, text, lang; rows without an id or language teach nothing. The caller leaves out held-out rows."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    chosen = bounded_sample(known.select("doc_id", "lang"), "lang", sample).distinct()
    train = known.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"])  # at most sample ids a language
    train = train.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = train.mapInArrow(_featurise, "doc_id long, lang string, idx array<int>, counts array<int>").toArrow()
    langs = np.array(found.column("lang").to_pylist(), object)
    ids = found.column("doc_id").to_numpy()
    parts = {c: [x for chunk in found.column(c).chunks for x in chunk.to_numpy(zero_copy_only=False)] for c in ("idx", "counts")}
    pairs = [(i, c.astype(np.float64)) for i, c in zip(parts["idx"], parts["counts"], strict=True)]
    used = [k for k in np.lexsort((langs.astype(str), ids)) if len(pairs[k][0])]
    languages = tuple(sorted({langs[k] for k in used}))
    if not languages:
        return LanguageModel((), np.zeros(1 << BITS), np.zeros((1 << BITS, 0), np.float32), np.zeros(0), 1.0)
    summed = known.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    rows_with = np.zeros((1 << BITS) + 1)
    rows_with[summed.column(0).to_numpy()] = summed.column(1).to_numpy()
    idf = np.log((1 + rows_with[-1]) / (1 + rows_with[:-1])) + 1.0
    rows = [_tfidf(*pairs[k], idf) for k in used]
    y = np.array([languages.index(langs[k]) for k in used])
    aside = np.arange(len(rows)) % ASIDE == 0 if len(rows) >= 10 * ASIDE else np.zeros(len(rows), bool)
    fit = [r for r, a in zip(rows, aside, strict=True) if not a]
    w, b = ftrl.fit_multinomial(fit, y[~aside], len(languages), 1 << BITS, alpha=1.0, l1=0.02, l2=0.002, epochs=3)
    logits = np.array([v @ w[i] + b for i, v in (r for r, a in zip(rows, aside, strict=True) if a)]).reshape(-1, len(languages))
    return LanguageModel(languages, idf, w.astype(np.float32), b, ftrl.temperature(logits, y[aside]))


def predict_language(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """The other columns with ``lang_pred`` and ``score``."""
    return with_language(df, model, text, keep_text=False)


def with_language(df: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """As ``predict_language``, under other names if given, and the text column stays unless ``keep_text`` is false."""
    df = set_aside(df, names, keep=(text,))
    carried = [c for c in df.columns if keep_text or c != text]
    schema = T.StructType([*[df.schema[c] for c in carried], T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    at = df.columns.index(text)
    stay = [i for i, c in enumerate(df.columns) if keep_text or c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for place in range(batch.num_rows):
                t = batch.column(at)[place].as_py()
                if t is None or not model.languages or not has_letter(t):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = model.probabilities(t)
                k = int(p.argmax())
                langs.append(model.languages[k])
                scores.append(float(p[k]))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*carried, *names])

    return df.mapInArrow(run, schema)
