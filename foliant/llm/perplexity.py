"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of characters (code points), order ``ORDER``, over whole texts, so that a context reaches from a word into the
one before it. Its tables grow with the text and stay tables: n-grams of all documents are counted per task and summed by
n-gram, with the counts that trusted text gives them (0 for most); continuation counts, contexts and interpolated
probabilities are joins of those tables, each sharded by n-gram or context, order by order. The result is the log
probability of each n-gram that any document has.

A document's perplexity is the join of its n-gram counts with that table, sharded by n-gram. A task makes its documents'
n-grams into chunks: for each n-gram the documents of the chunk that hold it, with counts, sent once to the n-gram's shard,
sorted and compressed. A shard reads its part of the table, then one chunk at a time, and returns what each document of the
chunk sums up to over the shard; these are summed by chunk. An n-gram that every document has is one entry of each chunk,
so none makes a hot key.

N-grams are known to that join by 50 bits of a hash; of 10^9 n-grams, one in a million shares its bits with another.

A language's threshold is a quantile of the perplexity of trusted documents that the counts leave out (one in
``CALIBRATION``), so that it is fair to documents the model never saw. A short document's mean is drawn towards its
language's mean by ``PRIOR`` characters before it is compared.

Defined results: a null or empty text has a null perplexity and is not kept; a null or rare language (under ``LEAST``
calibration documents) takes the threshold of all languages together; without any calibration document every
non-empty text is kept; repeated rows are scored one by one; an empty table gives no rows; U+0002 and U+0003, which mark the
ends of a text, count as U+FFFD inside it; further columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from foliant.session import cut_lineage

ORDER = 4
START, END, OTHER = 2, 3, 0xFFFD
#: An unseen symbol is one of all code points.
SYMBOLS = 0x110000
QUANTILE = 0.99
PRIOR = 300
CALIBRATION = 4
LEAST = 30
#: Languages with a threshold of their own; more are an error.
LANGUAGES = 1_000
#: Trusted ids up to this number are sent to every task; more are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Characters of a chunk, and documents, which 14 bits number.
CHUNK_CHARS, CHUNK_DOCS = 4 << 20, 1 << 14
#: Distinct n-grams that a counting task holds.
HELD = 2_000_000
KEY_BITS = 50
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def points(text: str, order: int = ORDER) -> np.ndarray:
    """Code points of a text, with ``order - 1`` starts before and an end after."""
    own = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if ((own == START) | (own == END)).any():
        own = np.where((own == START) | (own == END), np.uint32(OTHER), own)
    return np.concatenate([np.full(order - 1, START, np.uint32), own, np.array([END], np.uint32)])


def _hashes(p: np.ndarray, order: int) -> np.ndarray:
    """The hash of each n-gram, by its first place."""
    symbols = p.astype(np.uint64) + np.uint64(1)
    h = symbols
    for k in range(1, order):
        h = h[:-1] * _STEP + symbols[k:]
    x = (h ^ (h >> np.uint64(32))) * _MIX
    return ((x ^ (x >> np.uint64(29))) * _MIX) >> np.uint64(64 - KEY_BITS)


def _pieces(text: str, order: int) -> Iterator[np.ndarray]:
    """A text's points in pieces of bounded length, each with the ``order - 1`` points before it."""
    p = points(text, order)
    for at in range(0, len(p) - order + 1, CHUNK_CHARS):
        yield p[at : at + CHUNK_CHARS + order - 1]


def _summed(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, with the sums of their counts."""
    by = np.argsort(values)
    values, counts = values[by], counts[by]
    first = _firsts(values)
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def _firsts(values: np.ndarray) -> np.ndarray:
    """Places where a sorted array's values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values = np.sort(values)
    first = _firsts(values)
    return values[first], np.diff(np.append(first, len(values)))


# Counting ---------------------------------------------------------------------------------------------------------------


def _count_grams(order: int):
    """N-grams of texts with their counts in trusted ones, summed per task as far as ``HELD`` of them. Columns: text, trusted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[bool, np.ndarray]] = []
        size = 0
        keys, n, grams = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, order), np.uint32)

        def summed(keys: np.ndarray, n: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            by = np.argsort(keys)
            first = _firsts(keys[by])
            return keys[by[first]], np.add.reduceat(n[by], first) if len(first) else n, grams[by[first]]

        def add() -> None:
            nonlocal waiting, size, keys, n, grams
            if waiting:
                points_ = np.concatenate([p for _, p in waiting])
                ends = np.cumsum([len(p) for _, p in waiting])
                inside = np.ones(len(points_), bool)  # n-grams that reach from one text into the next are none
                for back in range(1, order):
                    inside[ends - back] = False
                trusted = np.repeat(np.array([t for t, _ in waiting], np.int64), [len(p) for _, p in waiting])[inside]
                windows = np.lib.stride_tricks.sliding_window_view(points_, order)[inside[: len(points_) - order + 1]]
                found = summed(_hashes(points_, order)[inside[: len(points_) - order + 1]], trusted, windows)
                keys, n, grams = summed(*(np.concatenate(x) for x in zip((keys, n, grams), found, strict=True)))
            waiting, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal keys, n, grams
            for at in range(0, len(keys), 1 << 18):
                flat = grams[at : at + (1 << 18)].tobytes().decode("utf-32-le", "surrogatepass")
                text = [flat[i : i + order] for i in range(0, len(flat), order)]
                yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(n[at : at + (1 << 18)])], ["g", "n"])
            keys, n, grams = keys[:0], n[:0], grams[:0]

        for batch in batches:
            for place in range(batch.num_rows):
                t = batch.column(0)[place].as_py()
                for p in _pieces(t, order) if t else ():
                    waiting.append((bool(batch.column(1)[place].as_py()), p))
                    size += len(p)
                    if size >= CHUNK_CHARS // 2:
                        add()
                        if len(keys) >= HELD:
                            yield from flush()
        add()
        yield from flush()

    return run


def _discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts of an order from its numbers of n-grams seen once to four times."""
    n = {r["n"]: r["m"] for r in counts.where("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("m")).collect()}
    n1, n2, n3, n4 = (n.get(i, 0) for i in (1, 2, 3, 4))
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    ratio = lambda a, b: b / a if a else 0.0
    raw = (1 - 2 * y * ratio(n1, n2), 2 - 3 * y * ratio(n2, n3), 3 - 4 * y * ratio(n3, n4))
    return tuple(float(np.clip(d, 0.05, top)) for d, top in zip(raw, (0.95, 1.9, 2.9), strict=True))


def log_probabilities(texts: DataFrame, text: str = "text", trusted: str = "trusted", order: int = ORDER) -> DataFrame:
    """(g, logp) for each n-gram that any text has, under the model of those whose ``trusted`` is true."""
    counted = texts.select(F.col(f"`{text}`"), F.col(f"`{trusted}`")).mapInArrow(_count_grams(order), "g string, n long")
    grams = {order: cut_lineage(counted.groupBy("g").agg(F.sum("n").alias("n")))}  # 0: no trusted text has it
    for k in range(order - 1, 0, -1):
        continued = F.sum(F.when(F.col("n") > 0, 1).otherwise(0)).alias("n")
        grams[k] = cut_lineage(grams[k + 1].groupBy(F.substring("g", 2, k).alias("g")).agg(continued))
    p = None
    for k in range(1, order + 1):
        d1, d2, d3 = _discounts(grams[k].where("n > 0"))
        d = F.when(F.col("n") == 0, 0.0).when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        own = grams[k].select("g", "n", d.alias("d"), F.substring("g", 1, k - 1).alias("context"), F.substring("g", 2, k - 1).alias("rest"))
        contexts = own.where("n > 0").groupBy("context").agg(F.sum("n").alias("total"), (F.sum("d") / F.sum("n")).alias("below"))
        lower = F.lit(1.0 / SYMBOLS) if p is None else F.col("lower")
        joined = own.join(contexts, "context", "left")
        if p is not None:
            joined = joined.join(p.select(F.col("g").alias("rest"), F.col("p").alias("lower")), "rest")
        seen = F.coalesce((F.col("n") - F.col("d")) / F.col("total"), F.lit(0.0))
        p = cut_lineage(joined.select("g", (seen + F.coalesce("below", F.lit(1.0)) * lower).alias("p")))
    return p.select("g", F.log("p").alias("logp"))


# Scoring ----------------------------------------------------------------------------------------------------------------


def _planes(values: np.ndarray) -> bytes:
    """Bytes of whole numbers by significance, so that a compressor finds the zeros together."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(data: memoryview, dtype: type, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.frombuffer(data, np.uint8, n * size).reshape(size, n).T.copy().view(dtype).reshape(n)


def _encoded(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted (n-gram, document) numbers with counts, compressed; the raw size first."""
    keys, doc = values >> np.uint64(14), (values & np.uint64(CHUNK_DOCS - 1)).astype(np.int64)
    first = _firsts(keys)
    own = keys[first]
    step = np.diff(doc, prepend=0)
    step[first] = doc[first]
    docs_of = np.diff(np.append(first, len(keys))).astype(np.uint16)
    many = np.flatnonzero(counts > 1)
    raw = b"".join(
        [
            np.array([len(own), len(doc), len(many)], np.int64).tobytes(),
            _planes(np.diff(own, prepend=np.uint64(0))),
            _planes(docs_of),
            _planes(step.astype(np.uint16)),
            _planes(np.diff(many, prepend=0).astype(np.uint32)),
            _planes(counts[many].astype(np.uint32)),
        ]
    )
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _decoded(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-grams, how many documents have each, then documents and counts."""
    raw = memoryview(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd"))
    n, m, many = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    at = 24
    out = []
    for dtype, size in ((np.uint64, n), (np.uint16, n), (np.uint16, m), (np.uint32, many), (np.uint32, many)):
        out.append(_from_planes(raw[at:], dtype, size))
        at += size * np.dtype(dtype).itemsize
    keys, docs_of = np.cumsum(out[0]), out[1].astype(np.int64)
    steps = np.cumsum(out[2].astype(np.int64))
    first = np.cumsum(docs_of) - docs_of
    doc = steps - np.repeat(steps[first] - out[2][first], docs_of)
    counts = np.ones(m, np.int64)
    counts[np.cumsum(out[3].astype(np.int64))] = out[4]
    return keys, docs_of, doc, counts


def _shard_ends(shards: int) -> np.ndarray:
    return np.array([(s << KEY_BITS) // shards for s in range(1, shards)], np.uint64)


def _routed_schema(ids: list[T.StructField]) -> T.StructType:
    fields = [T.StructField("shard", T.IntegerType()), T.StructField("kind", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("data", T.BinaryType())]
    return T.StructType([*fields, T.StructField("docs", T.ArrayType(T.StructType([*ids, T.StructField("_symbols", T.LongType())])))])


def score_texts(df: DataFrame, table: DataFrame, text: str = "text", shards: int | None = None, order: int = ORDER) -> DataFrame:
    """The other columns with ``_nll`` (negative log likelihood of the whole text) and ``_symbols`` (its code points and end)."""
    shards = shards or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [c for c in df.columns if c != text]
    ids = [df.schema[c] for c in names]
    routed = _routed_schema(ids)
    arrow = to_arrow_schema(routed)
    ends = _shard_ends(shards)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        found: list[tuple[np.ndarray, np.ndarray]] = []  # n-gram and document, count
        waiting: list[tuple[int, np.ndarray]] = []  # document, points
        docs: list[dict] = []
        size = chars = 0

        def add() -> None:
            nonlocal waiting, size
            if not waiting:
                return
            lengths = np.array([len(p) for _, p in waiting])
            doc = np.repeat(np.array([d for d, _ in waiting], np.uint64), lengths)
            inside = np.ones(len(doc), bool)
            for back in range(1, order):
                inside[np.cumsum(lengths) - back] = False
            inside = inside[: len(doc) - order + 1]
            h = _hashes(np.concatenate([p for _, p in waiting]), order)
            found.append(_counted((h[inside] << np.uint64(14)) | doc[: len(inside)][inside]))
            waiting, size = [], 0

        def chunk() -> pa.RecordBatch:
            nonlocal made, docs, chars
            add()
            cid = (task << 32) + made
            rows: list[tuple] = [(cid % shards, 2, cid, None, docs)]
            if found:
                values, counts = found[0] if len(found) == 1 else _summed(*(np.concatenate(x) for x in zip(*found, strict=True)))
                cuts = [0, *np.searchsorted(values, ends << np.uint64(14)).tolist(), len(values)]
                rows += [(s, 1, cid, _encoded(values[a:z], counts[a:z]), None) for s, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
                found.clear()
            made += 1
            docs, chars = [], 0
            return _table(rows, arrow)

        for batch in batches:
            for place in range(batch.num_rows):
                t = batch.column(-1)[place].as_py()
                if docs and (len(docs) == CHUNK_DOCS or chars + len(t or "") > CHUNK_CHARS):
                    yield chunk()
                docs.append({**{c: batch.column(i)[place].as_py() for i, c in enumerate(names)}, "_symbols": len(t) + 1 if t else 0})
                chars += len(t or "")
                for p in _pieces(t, order) if t else ():
                    waiting.append((len(docs) - 1, p))
                    size += len(p)
                    if size >= CHUNK_CHARS:
                        add()
        if docs:
            yield chunk()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            joined = "".join(batch.column(0).to_pylist())
            keys = _hashes(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), order)[::order]
            by = np.argsort(keys)
            keys, w = keys[by], batch.column(1).to_numpy(zero_copy_only=False)[by]
            cuts = [0, *np.searchsorted(keys, ends).tolist(), len(keys)]
            rows = [(s, 0, 0, keys[a:z].tobytes() + w[a:z].tobytes(), None) for s, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
            if rows:
                yield _table(rows, arrow)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        keys, w = np.zeros(1, np.uint64), np.zeros(1)
        shard = None
        for batch in batches:
            for place in range(batch.num_rows):
                s, kind, cid, data = (batch.column(i)[place].as_py() for i in range(4))
                if s != shard:
                    shard, parts, keys, w = s, [], np.zeros(1, np.uint64), np.zeros(1)
                if kind == 0:
                    n = len(data) // 16
                    parts.append((np.frombuffer(data, np.uint64, n), np.frombuffer(data, np.float64, n, n * 8)))
                    continue
                if parts:
                    keys = np.concatenate([k for k, _ in parts])
                    by = np.argsort(keys)
                    keys, w = keys[by], np.concatenate([x for _, x in parts])[by]
                    parts = []
                if kind == 2:
                    yield batch.slice(place, 1)
                    continue
                own, docs_of, doc, counts = _decoded(data)
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                weight = np.where(keys[at] == own, w[at], 0.0)
                total = np.bincount(doc, weights=np.repeat(weight, docs_of) * counts)
                has = np.flatnonzero(total)
                yield _table([(s, 1, cid, has.astype(np.uint16).tobytes() + total[has].astype(np.float32).tobytes(), None)], arrow)

    result = T.StructType([*ids, T.StructField("_nll", T.DoubleType()), T.StructField("_symbols", T.LongType())])
    out_arrow = to_arrow_schema(result)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, cid = np.zeros(CHUNK_DOCS), None
        for batch in batches:
            for place in range(batch.num_rows):
                if batch.column(2)[place].as_py() != cid:
                    cid = batch.column(2)[place].as_py()
                    total[:] = 0.0
                if batch.column(1)[place].as_py() == 1:
                    data = batch.column(3)[place].as_py()
                    n = len(data) // 6
                    total[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, np.float32, n, 2 * n)
                    continue
                docs = batch.column(4).slice(place, 1).flatten()
                symbols = docs.field(len(names)).to_numpy(zero_copy_only=False)
                nll = -total[: len(symbols)]
                yield pa.RecordBatch.from_arrays([*[docs.field(i) for i in range(len(names))], pa.array(nll + 0.0), docs.field(len(names))], schema=out_arrow)

    own = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("_text"))
    both = table.select("g", "logp").mapInArrow(weigh, routed).unionByName(own.mapInArrow(route, routed))
    joined = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "kind", "chunk").mapInArrow(join, routed)
    return joined.repartition("chunk").sortWithinPartitions("chunk", "kind", "shard").mapInArrow(add_up, result)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
def judge_quality(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``docs``: doc_id, text, lang. ``trusted``: doc_id of trusted documents. Rows: doc_id, lang, perplexity, threshold, kept."""
    ids = trusted.select("doc_id").where("doc_id is not null").distinct().withColumn("_aside", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)) == 0)
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    own = docs.select("doc_id", "text", "lang")
    marked = own.select("doc_id", "text").join(ids, "doc_id", "left").select("text", F.coalesce(~F.col("_aside"), F.lit(False)).alias("trusted"))
    scored = cut_lineage(score_texts(own, log_probabilities(marked)))
    mean = F.col("_nll") / F.col("_symbols")
    held = scored.where("_symbols > 0").join(ids.where("_aside").select("doc_id"), "doc_id", "left_semi")
    means = held.groupBy("lang").agg(F.count(F.lit(1)).alias("_n"), (F.sum("_nll") / F.sum("_symbols")).alias("_mean")).where(f"_n >= {LEAST} and lang is not null")
    overall = held.agg((F.sum("_nll") / F.sum("_symbols")).alias("m")).first()["m"]
    level = {r["lang"]: r["_mean"] for r in means.limit(LANGUAGES + 1).collect()}
    if len(level) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")

    def drawn(df: DataFrame) -> DataFrame:
        table = _levels(df, level, overall)
        return table.withColumn("_drawn", (F.col("_nll") + PRIOR * F.col("_level")) / (F.col("_symbols") + PRIOR))

    if overall is None:
        bounds, rest = {}, None
    else:
        calibrated = drawn(held)
        q = F.percentile_approx("_drawn", F.lit(quantile), F.lit(10_000))
        bounds = {r["lang"]: r["q"] for r in calibrated.where(F.col("lang").isin(*level) if level else F.lit(False)).groupBy("lang").agg(q.alias("q")).collect()}
        rest = calibrated.agg(q.alias("q")).first()["q"]
    judged = drawn(scored) if overall is not None else scored.withColumn("_drawn", F.lit(0.0))
    bounded = _levels(judged, bounds, rest, "_bound")
    limit = F.col("_bound")
    return bounded.select(
        "doc_id",
        "lang",
        F.when(F.col("_symbols") > 0, F.exp(mean)).alias("perplexity"),
        F.exp(limit).alias("threshold"),
        ((F.col("_symbols") > 0) & F.coalesce(F.col("_drawn") <= limit, F.lit(True))).alias("kept"),
    )


def _levels(df: DataFrame, by_lang: dict[str, float], other: float | None, name: str = "_level") -> DataFrame:
    """A constant per language as a column; languages are few (``LANGUAGES`` at most)."""
    pick = F.lit(other).cast("double")
    if by_lang:
        table = F.create_map(*[x for k, v in sorted(by_lang.items()) for x in (F.lit(k), F.lit(float(v)))])
        pick = F.coalesce(F.try_element_at(table, F.col("lang")), pick)
    return df.withColumn(name, pick)
