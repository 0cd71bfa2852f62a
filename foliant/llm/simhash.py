"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints are 64-bit majorities of the XXH64 of word shingles. Equal fingerprints collapse to one class. A
fingerprint is cut into two 23-bit segments and one of 18 bits; with at most two differing bits, by the pigeonhole
principle, one of these holds: the second segment is equal and the first within 2, the first is equal and the second
within 2, or the third is equal and the first within 2. So each class gets the Golay keys of the one segment joined to
the other segment as it is (at most 18 keys of 35 or 30 bits), the classes are joined on the keys, and each pair is verified.

Keys that more than ``HOT`` classes share are not paired. Their classes get 65 keys of another kind, every word within
one bit of the fingerprint: two fingerprints are within two bits exactly if they share such a word, and all that share
one are within two bits of each other, so linking each to the least of them loses no component, whatever the group's size.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; repeated rows are kept;
an empty table gives no rows; rows with a null id are kept, link as others do, and take the least id of their component
(null if none has one).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.columns import each, free_name
from foliant.operators.components import components
from foliant.llm.golay import fuzzy_keys
from foliant.session import cut_lineage

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Classes of one key that are still joined in pairs.
HOT = 48
#: Ids up to this number are sent to every task (some 100 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_SPLIT = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
_ASCII_UPPER = re.compile(r"[A-Z]")


def _words(text: str) -> list[str]:
    if text.isascii():
        text = text.lower()
    elif _ASCII_UPPER.search(text):
        text = text.translate(_LOWER)
    words = _SPLIT.split(text)
    return words[words[0] == "" : len(words) - (words[-1] == "")]


def fingerprint(text: str, shingle: int = SHINGLE, chunk: int = 1 << 16) -> int:
    """The unsigned fingerprint of a whole text; long texts are hashed in pieces of ``chunk`` shingles."""
    words = _words(text)
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, chunk):
        own = words[at : min(at + chunk, n) + shingle - 1]
        if shingle == 3 and len(own) >= 3:
            h = [digest(f"{a} {b} {c}", SEED) for a, b, c in zip(own, own[1:], own[2:])]
        elif len(own) < shingle:
            h = [digest(" ".join(own), SEED)]
        else:
            h = [digest(" ".join(own[i : i + shingle]), SEED) for i in range(len(own) - shingle + 1)]
        bits = np.unpackbits(np.array(h, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """The other columns with the fingerprint as a signed long."""
    names = [c for c in df.columns if c != text]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(name, T.LongType())])
    at = df.columns.index(text)
    stay = [i for i in range(len(df.columns)) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t or "") for t in each(batch.column(at))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in stay], pa.array(fp)], [*names, name])

    return df.mapInArrow(run, schema)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        u = fp.view(np.uint64)
        first, second, third = (u & np.uint64(0x7FFFFF)), (u >> np.uint64(23) & np.uint64(0x7FFFFF)), u >> np.uint64(46)
        keys = []
        for family, (fuzzy, exact) in enumerate(((first, second), (second, first), (first, third))):
            k = fuzzy_keys(fuzzy)
            full = (np.int64(family) << 60) | (exact.astype(np.int64)[:, None] << 12) | k
            keys.append(np.where(k < 0, np.int64(-1), full))
        table = np.concatenate(keys, axis=1)
        row, col = np.nonzero(table >= 0)
        yield pa.RecordBatch.from_arrays([pa.array(table[row, col]), pa.array(fp[row])], ["key", "fp"])


def _flips(fp: F.Column) -> F.Column:
    flips = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)))
    return F.concat(F.array(fp), flips)


def near_links(classes: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between different fingerprints of ``classes`` (one long column, fp): enough of them for the exact components."""
    keyed = classes.mapInArrow(_keyed, "key long, fp long")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(keyed.join(sizes, "key"))
    few = shared.where(F.col("n") <= hot)
    pairs = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    paired = pairs.where((F.col("a") < F.col("b")) & near).select("a", "b")
    many = shared.where(F.col("n") > hot).select("fp").distinct()
    around = many.select("fp", F.explode(_flips(F.col("fp"))).alias("word"))
    least = around.groupBy("word").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    starred = around.join(least, "word").where("fp <> a").select("a", F.col("fp").alias("b"))
    return paired.union(starred).distinct()


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id): the least key of all texts that links reach."""
    marked = cut_lineage(fingerprints(df.select(F.col(f"`{key}`"), F.col(f"`{text}`").alias("_text")), "_text"))
    classes = cut_lineage(marked.groupBy("fp").agg(F.min(key).alias("least")))
    roots = components(near_links(classes.select("fp")))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = rooted.join(whole, "root").select("fp", "component_id")
    return marked.join(labels, "fp")


def fingerprint_text(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(df: DataFrame, key: str = "doc_id", text: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """The same columns with one row of each component: that of the least key (of repeated keys, the least text).

    Rows with a null key can't be told from each other and stay. Only ids are shuffled where those to leave out are few
    enough to be sent to every task; otherwise rows are joined with them by shuffle.
    """
    found = near_duplicates(df, key, text).select(F.col(f"`{key}`").alias("_id"), "component_id").where("_id is not null")
    by_id = found.groupBy("_id").agg(F.max(F.col("_id") == F.col("component_id")).alias("_first"), F.count(F.lit(1)).alias("_n"))
    out = cut_lineage(by_id.where("not _first or _n > 1").select("_id", "_first"))
    counts = out.agg(F.count(F.lit(1)).alias("n"), F.count_if("_first").alias("repeated")).first()
    own, other = F.col(f"`{key}`"), free_name(df, "_id")
    out = out.withColumnRenamed("_id", other)
    small = (lambda x: F.broadcast(x)) if counts["n"] <= broadcast_ids else (lambda x: x)
    kept = df.join(small(out.select(other)), own == F.col(other), "left_anti")
    if not counts["repeated"]:
        return kept
    again = df.join(small(out.where("_first").select(other)), own == F.col(other), "left_semi")
    whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    one = again.groupBy(own.alias("_id")).agg(F.min_by(whole, F.struct(F.col(f"`{text}`"), F.to_json(whole))).alias("_row"))
    return kept.unionByName(one.select("_row.*"))
