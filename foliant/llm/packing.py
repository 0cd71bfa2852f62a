"""Cost-balanced packing of token sequences.

A document costs ``LINEAR`` per token and ``QUADRATIC`` per squared token (attention inside the document). Documents are
packed in blocks: the whole token ids of at most ``BLOCK_TOKENS`` tokens of one input task, so that a block fits in
memory and nothing is shuffled. Within a block, pieces of a full sequence are cut off long documents first; the rest go,
in descending length, to the cheapest sequence that has room. What finds no room is cut to fill the gaps, and the last
tokens of a block go into sequences of a power of two, which need no padding. Hence a block has no padding at all.

A sequence's id is the input task and a counter in it; a task that is run again gives the same ids.

Defined results: a null or empty text has the end id only; repeated rows are packed one by one; an empty table gives no
rows; a text of any length is read whole, and a document longer than a block is a block of its own.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 4096
LINEAR = 1.0
QUADRATIC = 1.0 / 1024
BLOCK_TOKENS = 4_000_000
END_ID = 2
Piece = tuple[int, int, int, int, int]  # document, start, length, sequence, offset


# How the tokenizer parts a text into words. Where a text has only the characters of _LATIN, small letters and
# word classes are those of Python's re, and no character composes with another.
_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_LATIN = re.compile("[\t-\r -~\xa0-\xb1\xb4-\xb8\xba\xbb\xbf-\u012f\u0131-\u024f]*")


# Bytes of Latin-1 that _LATIN has.
_LATIN_BYTES = bytes(c for c in range(256) if _LATIN.fullmatch(chr(c)))


def _is_latin(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _LATIN_BYTES)
    except UnicodeEncodeError:
        return _LATIN.fullmatch(text) is not None


# A mark that ends a word; parted from it, the word is found again wherever it stands.
_MARK = re.compile(r"([.,;:!?])(?<=[^\W_].)(?=\s)")


def _byte_letters() -> dict[int, int]:
    """A byte's letter in a byte-level vocabulary: itself where it prints, else the next code point from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in prints)}


class WordTokens(dict):
    """What stands between spaces to its ids as bytes of unsigned 16 or 32 bits, in two generations, so that its memory stays bounded.

    A text of Latin characters is parted at spaces here and each part's ids are looked up. A part that is new is parted
    into words with the tokenizer's rule, and the tokenizer's model has each word's ids. Any other text goes to the
    tokenizer whole.
    """

    MOST = 400_000
    #: Longer parts that are no words seldom come again and are not kept.
    SHORT = 12

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one core a task
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.parted = words_are_known(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = np.dtype(self.code)
        self.older: dict[str, bytes] = {}
        self.letters = _byte_letters()
        self.model = self.tokenizer.model.tokenize

    def __missing__(self, part: str) -> bytes:
        ids = self.older.get(part)
        if ids is None:
            words = [part] if part.isalpha() else _WORD.findall(part)
            if len(words) > 1:
                ids = b"".join([self[w] for w in words])
                if len(part) > self.SHORT:
                    return ids
            elif words:
                spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                ids = array(self.code, [t.id for t in self.model(spelled)]).tobytes()
            else:
                return b""
        if len(self) >= self.MOST:
            self.older = dict(self)
            self.clear()
        self[part] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        low = text.lower()
        if self.parted and "<|" not in text and _is_latin(text):
            return np.frombuffer(b"".join(map(self.__getitem__, _MARK.sub(r" \1", low).split())), self.dtype)
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)


_tokens: dict[str, WordTokens] = {}


def _word_tokens(path: str) -> WordTokens:
    """The words known to this worker, kept from task to task."""
    if path not in _tokens:
        _tokens.clear()
        _tokens[path] = WordTokens(path)
    return _tokens[path]


def words_are_known(tokenizer_json: str) -> bool:
    """Whether a tokenizer makes letters small and parts words as ``_WORD`` does, each with its own ids by bytes."""
    with open(tokenizer_json, encoding="utf-8") as f:
        spec = json.load(f)
    steps = [n.get("type") for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    first, *more = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    rule = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    by_rule = first.get("pattern") == {"Regex": rule} and bool(first.get("invert"))
    by_bytes = [(m.get("type"), m.get("add_prefix_space"), m.get("use_regex")) for m in more] == [("ByteLevel", False, False)]
    return steps == ["NFC", "Replace", "Lowercase"] and by_rule and by_bytes and not spec.get("post_processor")


def _parts(tokens: int) -> Iterator[int]:
    """Powers of two that sum to ``tokens``, largest first."""
    for bit in range(tokens.bit_length() - 1, -1, -1):
        if tokens >> bit & 1:
            yield 1 << bit


def pack(lengths: Iterable[int], length: int = LENGTH) -> list[Piece]:
    """Pieces of documents with these token counts; sequences are numbered from 0, offsets are gapless from 0."""
    out: list[Piece] = []
    rest: list[tuple[int, int, int]] = []  # length, document, start
    sequences = 0
    for doc, n in enumerate(lengths):
        for start in range(0, n - length + 1, length):
            out.append((doc, start, length, sequences, 0))
            sequences += 1
        if n % length:
            rest.append((n % length, doc, n - n % length))
    rest.sort(key=lambda r: (-r[0], r[1]))
    total = sum(r[0] for r in rest)
    full = total // length
    fill = [0] * full
    ready = [(0.0, s) for s in range(full)]  # by cost, among them all that have room for the piece at hand
    narrow: list[tuple[int, float, int]] = []  # by room, largest first: those too full for it
    left: list[tuple[int, int, int]] = []
    for n, doc, start in rest:
        while narrow and -narrow[0][0] >= n:
            _, c, s = heapq.heappop(narrow)
            heapq.heappush(ready, (c, s))
        while ready:
            c, s = heapq.heappop(ready)
            if fill[s] + n <= length:
                out.append((doc, start, n, sequences + s, fill[s]))
                fill[s] += n
                if fill[s] < length:
                    heapq.heappush(ready, (c + LINEAR * n + QUADRATIC * n * n, s))
                break
            heapq.heappush(narrow, (fill[s] - length, c, s))
        else:
            left.append((n, doc, start))
    gaps = [[sequences + s, fill[s], length - fill[s]] for s in range(full) if fill[s] < length]
    tail = total - full * length
    for k, part in enumerate(_parts(tail)):
        gaps.append([sequences + full + k, 0, part])
    gaps.reverse()
    for n, doc, start in left:
        while n:
            sequence, offset, room = gaps[-1]
            take = min(n, room)
            out.append((doc, start, take, sequence, offset))
            n, start = n - take, start + take
            if take == room:
                gaps.pop()
            else:
                gaps[-1] = [sequence, offset + take, room - take]
    return out


def pack_documents(
    df: DataFrame, tokenizer_json: str, key: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids, if asked for)."""
    fields = [
        df.schema[key],
        *[T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
        *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []),
    ]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _word_tokens(tokenizer_json)
        task, used = TaskContext.get().partitionId(), 0
        keys: list = []
        ids: list[np.ndarray] = []
        held = 0

        def block() -> pa.RecordBatch:
            nonlocal used
            pieces = pack([len(i) for i in ids], length)
            crc = [zlib.crc32(ids[d][s : s + n]) for d, s, n, _, _ in pieces]
            cols = list(zip(*pieces, strict=True))
            arrays = [
                pa.array([keys[d] for d in cols[0]], arrow_key),
                pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array([len(ids[d]) for d in cols[0]], pa.int64()),
                pa.array([(task << 32) + used + s for s in cols[3]], pa.int64()),
                pa.array(cols[4], pa.int64()),
            ]
            if with_ids:
                arrays.append(pa.array([ids[d][s : s + n].astype(np.int32) for d, s, n, _, _ in pieces], pa.list_(pa.int32())))
            used += max(cols[3]) + 1
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        arrow_key = pa.int64()
        for batch in batches:
            arrow_key = batch.schema.field(0).type
            for place, k in enumerate(batch.column(0).to_pylist()):
                own = tokens.encode(batch.column(1)[place].as_py() or "")
                ended = np.empty(len(own) + 1, "<u4")
                ended[:-1] = own
                ended[-1] = end_id
                own = ended
                if ids and held + len(own) > BLOCK_TOKENS:
                    yield block()
                    keys, ids, held = [], [], 0
                keys.append(k)
                ids.append(own)
                held += len(own)
        if ids:
            yield block()

    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(run, schema)
