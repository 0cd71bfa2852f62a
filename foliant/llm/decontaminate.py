"""Benchmark decontamination: a BM25 inverted index of test items, queried by every passage with block-max pruning.

Documents are read as passages of ``2 * WINDOW`` words that overlap by half, so that any item of up to ``WINDOW`` words
lies whole in one; longer items are indexed in parts of ``WINDOW`` words, which only find the place. Impacts are divided by the item's threshold
(``THRESHOLD`` of its score against itself), so every item is due at a score of 1. An item's words outside its essential
ones are worth ``REST`` at most, so it can only be due where its essential words are worth what is then missing. That
sum is taken over a document first, then over its passages, from the few essential words in them; where no item gets
there, none is due. The passages left query the index by block-max WAND: the words' posting lists, each with the highest impact
of the list and of each run of ``BLOCK`` postings, are read side by side; the pivot is the first item that the lists' maxima can
bring to 1, it is scored where the maxima of its blocks can as well, and otherwise the lists skip past those blocks. Every item that is due is then verified as a whole: its
question and its answer must each be found in the passage, in order, by ``OVERLAP`` of their words. For an item of several
parts, the passage is widened by twice the words that the item has before and after the part that is due.

The benchmark is cut into blocks of ``BLOCK_ITEMS`` test items or ``BLOCK_WORDS`` words, whichever ends first; a task and the driver
hold the index of one block, whatever the size of the benchmark. Each further block is a further pass over the documents, whose
rows are written to the shared checkpoint folder before the next block is read. An item longer than that is a block of its own.

Defined results: null and empty texts hold nothing and items without words match nothing; an item with a null id is
reported under it; repeated documents and items are each reported; empty tables give no rows.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import cut_lineage

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
WINDOW = 64
_END = 1 << 62
_at = itemgetter(0)
#: What the words of an item outside its essential ones are worth at most, in units of its threshold.
REST = 0.8
#: Postings of a block-max block.
BLOCK = 64
BLOCK_ITEMS, BLOCK_WORDS = 20_000, 2_000_000
_WORD = re.compile(r"[^\W_]+")
_ANSWER = re.compile(r"\b(?:answer|antwort|réponse|respuesta)\s*:", re.IGNORECASE)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """Words before and after the last answer cue or question mark that has words on both sides; else the two halves."""
    cuts = [(m.start(), m.end()) for m in _ANSWER.finditer(text)] or [(m.start(), m.end()) for m in re.finditer(r"\?", text)]
    for start, end in reversed(cuts):
        q, a = words_of(text[:start]), words_of(text[end:])
        if q and a:
            return q, a
    w = words_of(text)
    half = (len(w) + 1) // 2
    return w[:half], w[half:]


def common_in_order(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := places.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Postings:
    """A word's parts in order with their impacts, and the highest impact of the list and of each ``BLOCK`` of it."""

    __slots__ = ("highest", "impacts", "maxima", "parts")

    def __init__(self, posts: Sequence[tuple[int, float]]):
        self.parts = array("q", [p for p, _ in posts])
        self.impacts = array("d", [x for _, x in posts])
        self.maxima = array("d", [max(self.impacts[i : i + BLOCK]) for i in range(0, len(posts), BLOCK)])
        self.highest = max(self.maxima)

    def __reduce__(self):
        return Postings, (list(zip(self.parts, self.impacts)),)


@dataclass
class ItemIndex:
    """One block of items: postings in item order with block maxima, and the essential words of each item."""

    item_ids: list
    whole: list[tuple[list[str], list[str]]] = field(default_factory=list)  # question, answer
    parts: list[tuple[int, list[str], list[str]]] = field(default_factory=list)  # item, question and answer words in the part
    place: list[tuple[int, int]] = field(default_factory=list)  # words of the item before and after the part
    terms: dict[str, int] = field(default_factory=dict)
    postings: list[Postings] = field(default_factory=list)
    essential: dict[str, list[tuple[int, float]]] = field(default_factory=dict)
    needed: list[float] = field(default_factory=list)

    @classmethod
    def build(cls, items: Sequence[tuple[object, str | None]]) -> ItemIndex:
        index = cls([i for i, _ in items])
        index.whole = [question_and_answer(t or "") for _, t in items]
        for k, (q, a) in enumerate(index.whole):
            w = q + a
            for at in range(0, len(w), WINDOW):
                cut = min(max(len(q) - at, 0), WINDOW)
                part = w[at : at + WINDOW]
                index.parts.append((k, part[:cut], part[cut:]))
                index.place.append((at, max(len(w) - at - WINDOW, 0)))
        bags = [Counter(q + a) for _, q, a in index.parts]
        n = len(bags)
        rows_with = Counter(w for bag in bags for w in bag)
        mean = sum(sum(b.values()) for b in bags) / n if n else 1.0
        lists: dict[str, list[tuple[int, float]]] = {}
        for d, bag in enumerate(bags):
            size = sum(bag.values())
            impact = {
                w: math.log(1 + (n - rows_with[w] + 0.5) / (rows_with[w] + 0.5)) * c * (K1 + 1) / (c + K1 * (1 - B + B * size / mean)) for w, c in bag.items()
            }
            due = THRESHOLD * sum(impact.values())
            rest = sum(impact.values()) / due
            # long words are the rare ones in a corpus; which words are taken changes the speed only
            for w in sorted(bag, key=lambda w: (-len(w), w)):
                lists.setdefault(w, []).append((d, impact[w] / due))
                if rest > REST:
                    index.essential.setdefault(w, []).append((d, impact[w] / due))
                    rest -= impact[w] / due
            index.needed.append(1.0 - max(rest, 0.0) - 1e-9)
        for t, (w, posts) in enumerate(lists.items()):
            index.terms[w] = t
            index.postings.append(Postings(posts))
        return index

    def due(self, words: set[str]) -> list[tuple[int, float]]:
        """(part, score) of every part whose score reaches its threshold against these words, by block-max WAND."""
        least, found = 1.0 - 1e-9, []
        open_lists = [[p.parts[0], 0, p] for p in (self.postings[self.terms[w]] for w in words if w in self.terms)]  # part at hand, place, list

        def move(cursor: list, part: int) -> None:
            p = cursor[2]
            cursor[1] = bisect_left(p.parts, part, cursor[1])
            cursor[0] = p.parts[cursor[1]] if cursor[1] < len(p.parts) else _END

        while True:
            open_lists.sort(key=_at)
            reach, last = 0.0, -1
            for k, (part, _, p) in enumerate(open_lists):
                if part == _END:
                    break
                reach += p.highest
                if reach >= least:
                    last = k
                    break
            if last < 0:
                return found
            pivot = open_lists[last][0]
            while last + 1 < len(open_lists) and open_lists[last + 1][0] == pivot:
                last += 1
            ahead = open_lists[: last + 1]
            places = [bisect_left(p.parts, pivot, place) for _, place, p in ahead]
            inside = [(p, i) for (_, _, p), i in zip(ahead, places) if i < len(p.parts)]
            if sum(p.maxima[i // BLOCK] for p, i in inside) >= least:
                score = math.fsum(p.impacts[i] for p, i in inside if p.parts[i] == pivot)
                if score >= least:
                    found.append((pivot, score))
                goal = pivot + 1
            else:  # no part before the first of these blocks ends, or before the next list begins, can reach 1
                goal = min(p.parts[min((i // BLOCK + 1) * BLOCK, len(p.parts)) - 1] + 1 for p, i in inside)
                if last + 1 < len(open_lists):
                    goal = min(goal, open_lists[last + 1][0])
                goal = max(goal, pivot + 1)
            for cursor in ahead:
                move(cursor, goal)

    def retrieve(self, words: list[str]) -> Iterator[tuple[int, int, float]]:
        """(first word of the passage, part, score) of every part that is due in a passage."""
        essential = self.essential
        hits = [(i, w) for i, w in enumerate(words) if w in essential]
        worth: dict[int, float] = {}
        for w in {w for _, w in hits}:
            for part, impact in essential[w]:
                worth[part] = worth.get(part, 0.0) + impact
        open_parts = {part for part, total in worth.items() if total >= self.needed[part]}
        if not open_parts:
            return
        inside: dict[tuple[int, int], dict[str, float]] = {}  # by passage and item, the essential words in it
        for i, w in hits:
            for part, impact in essential[w]:
                if part in open_parts:
                    for s in (i // WINDOW - 1, i // WINDOW):
                        if s >= 0:
                            inside.setdefault((s * WINDOW, part), {})[w] = impact
        starts = sorted({start for (start, part), own in inside.items() if sum(own.values()) >= self.needed[part]})
        for start in starts:
            passage = words[start : start + 2 * WINDOW]
            if start and len(passage) <= WINDOW:
                continue  # the passage before holds all of it
            for part, score in self.due(set(passage)):
                yield start, part, score

    def search(self, text: str) -> dict[int, tuple[float, int, int]]:
        """Items of which one part is found by itself; ``leaks`` has those that are found as a whole."""
        words = words_of(text)
        found: dict[int, tuple[float, int, int]] = {}
        for start, part, score in self.retrieve(words):
            passage = words[start : start + 2 * WINDOW]
            item, q, a = self.parts[part]
            nq, na = common_in_order(q, passage), common_in_order(a, passage)
            if nq >= OVERLAP * len(q) and na >= OVERLAP * len(a) and score > found.get(item, (0.0,))[0]:
                found[item] = (score, start, nq + na)
        return found

    def leaks(self, text: str) -> dict[int, tuple[float, int, int]]:
        """Item to (highest score in units of its threshold, first word of the passage, words of the item in it)."""
        words = words_of(text)
        found: dict[int, tuple[float, int, int]] = {}
        for start, part, score in self.retrieve(words):
            item = self.parts[part][0]
            if score <= found.get(item, (0.0,))[0]:
                continue
            (q, a), (left, right) = self.whole[item], self.place[part]
            first = max(start - 2 * left, 0)
            passage = words[first : start + 2 * (WINDOW + right)]
            nq, na = common_in_order(q, passage), common_in_order(a, passage)
            if nq >= OVERLAP * len(q) and na >= OVERLAP * len(a):
                found[item] = (score, first, nq + na)
        return found


def _blocks(benchmark: DataFrame, item: str, text: str, size: int) -> Iterator[ItemIndex]:
    """Indexes of bounded blocks of items, one at a time on the driver."""
    block: list[tuple[object, str | None]] = []
    n = 0
    for r in benchmark.select(F.col(f"`{item}`"), F.col(f"`{text}`")).toLocalIterator():
        own = len(words_of(r[1] or ""))
        if block and (len(block) == size or n + own > BLOCK_WORDS):
            yield ItemIndex.build(block)
            block, n = [], 0
        block.append((r[0], r[1]))
        n += own
    if block:
        yield ItemIndex.build(block)


def _passes(blocks: Iterator[ItemIndex], scan: Callable[[ItemIndex], DataFrame]) -> Iterator[DataFrame]:
    """``scan`` of each block; where there are several, each is done before the next index is built."""
    first = next(blocks, None)
    second = next(blocks, None)
    if first is None or second is None:
        yield scan(first if first is not None else ItemIndex.build([]))
        return
    yield cut_lineage(scan(first))
    del first
    while second is not None:
        yield cut_lineage(scan(second))
        second = next(blocks, None)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS
) -> DataFrame:
    """(key, item, score, passage_start, n_common): every test item that a document holds; score 1 is the item's threshold."""
    source = docs.select(F.col(f"`{key}`"), F.col(f"`{text}`"))
    item_type = benchmark.schema[item].dataType
    schema = T.StructType(
        [
            docs.schema[key],
            T.StructField("item_id", item_type),
            T.StructField("score", T.DoubleType()),
            T.StructField("passage_start", T.LongType()),
            T.StructField("n_common", T.LongType()),
        ]
    )
    arrow_item = {T.LongType: pa.int64(), T.IntegerType: pa.int32()}.get(type(item_type), pa.string())

    def scan(index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, out = [], []
                for i in range(batch.num_rows):
                    for k, (score, start, n) in sorted(index.leaks(batch.column(1)[i].as_py() or "").items()):
                        rows.append(i)
                        out.append((index.item_ids[k], score, start, n))
                if rows:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(rows)),
                            pa.array(cols[0], arrow_item),
                            pa.array(cols[1], pa.float64()),
                            pa.array(cols[2], pa.int64()),
                            pa.array(cols[3], pa.int64()),
                        ],
                        schema.names,
                    )

        return source.mapInArrow(run, schema)

    found = None
    for part in _passes(_blocks(benchmark, item, item_text, block_items), scan):
        found = part if found is None else found.unionByName(part)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The same columns without the documents that hold a test item; a pass per block of items, no shuffle."""
    at = docs.columns.index(text)

    kept = docs

    def without(index: ItemIndex) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not index.leaks(batch.column(at)[i].as_py() or "") for i in range(batch.num_rows)], pa.bool_()))

        return kept.mapInArrow(run, docs.schema)

    for kept in _passes(_blocks(benchmark, item, item_text, block_items), without):  # noqa: B007
        pass
    return kept
