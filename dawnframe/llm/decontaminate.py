"""Benchmark decontamination by SimHash of item-sized windows.

Texts become lower-case words (letters and digits).  The index holds each benchmark item's 64-bit SimHash over its
five-word shingles.  A document is read in windows as long as an item; a window's SimHash looks up the index by
multi-index Hamming blocks: eight blocks of eight bits, each listed with all values within two bits, so any item within
``RADIUS`` = 23 bits shares at least one listed block.  Candidates are verified by exact weighted-shingle similarity:
sum of the smaller counts over sum of the larger counts of the shingles, at least ``SIMILARITY``.

Windows are laid only where the document has a shingle of some item: a window without one has similarity zero, so
nothing is lost, and clean documents cost one pass over their words.  Within reach of such a place windows start at
every word.

Of what the blocks list, only the items are compared that the document shares a shingle with, which loses nothing either.

The index is built from all items, once in each Python worker.  Its items are broadcast in blocks of at most ``BLOCK_CHARS`` characters of item text; a
larger benchmark is searched block after block over all documents.

Defined results: an item with fewer than five words is one shingle of all its words; items and documents without
words never match; a document shorter than an item is one window; null texts and ids match nothing or carry
their null; repeated rows are reported for each row once per (document, item); of equally similar windows the first is kept; an empty table
of documents or items gives an empty result; columns of the input other than ``doc_id`` and ``text`` (``item_id`` and ``text``)
are ignored by ``contaminations`` and kept by ``keep_uncontaminated``.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnframe.llm.arrow import pieces

SHINGLE_WORDS = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS, WITHIN = 8, 2
BLOCK_CHARS = 8_000_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _shingles(words: list[str], k: int) -> list[int]:
    digest = xxhash.xxh64_intdigest
    return [digest(" ".join(words[i : i + k])) for i in range(len(words) - k + 1)]


def _bits(shingles: list[int]) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each shingle."""
    return np.unpackbits(np.array(shingles, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1


def _prints(sums: np.ndarray) -> np.ndarray:
    """SimHashes (n x 8 bytes) of n rows of 64 sums."""
    return np.packbits(sums > 0, axis=1)


class Index:
    """Items of one block: the gate of their shingles, and the Hamming blocks of their fingerprints."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocabulary: dict[str, int] = {}
        self.items, self.gates, shapes = [], {}, {}
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k = min(SHINGLE_WORDS, len(words))
            numbers = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.uint64)
            shingles = _shingles(words, k)
            number = len(self.items)
            self.items.append((item_id, len(words), k, Counter(shingles)))
            self.gates.setdefault(k, []).extend((int(x), number) for x in self._keys(numbers, k))
            shapes.setdefault((len(words), k), []).append((number, _prints(_bits(shingles).sum(0)[None])[0]))
        for k, pairs in self.gates.items():
            keys = np.array([p[0] for p in pairs], np.uint64)
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(keys & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
            self.gates[k] = seen, keys[order], np.array([p[1] for p in pairs])[order]
        near = [v for v in range(256) if v.bit_count() <= WITHIN]
        self.shapes = {}
        for shape, members in shapes.items():
            numbers, prints = np.array([m[0] for m in members]), np.stack([m[1] for m in members])
            table = [{} for _ in range(BLOCKS)]
            for at, own in enumerate(prints):
                for block in range(BLOCKS):
                    for flip in near:
                        table[block].setdefault(int(own[block]) ^ flip, []).append(at)
            self.shapes[shape] = {int(n): at for at, n in enumerate(numbers)}, numbers, prints, [{value: frozenset(x) for value, x in t.items()} for t in table]

    @staticmethod
    def _keys(numbers: np.ndarray, k: int) -> np.ndarray:
        keys = numbers[: len(numbers) - k + 1].copy()
        for i in range(1, k):
            keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + numbers[i : len(numbers) - k + 1 + i]
        return keys ^ (keys >> np.uint64(32))

    def _touched(self, words: list[str]):
        """(item number, its hit positions) for the items that share a shingle with the words."""
        get = self.vocabulary.get
        numbers = np.array([get(w, 0) for w in words], np.uint64)
        for k, (seen, keys, owners) in self.gates.items():
            if len(words) < k:
                continue
            own = self._keys(numbers, k)
            at = np.flatnonzero(seen[(own & np.uint64((1 << 20) - 1)).astype(np.int64)])
            if len(at):
                low, high = np.searchsorted(keys, own[at]), np.searchsorted(keys, own[at], "right")
                hit: dict[int, list[int]] = {}
                for place, a, b in zip(at[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist(), strict=True):
                    for owner in set(owners[a:b].tolist()):
                        hit.setdefault(owner, []).append(place)
                yield from hit.items()

    def search(self, text: str | None) -> list[tuple[int, int, int, float]]:
        """(item_id, first word, words, similarity) of the best window for each item that the text contains."""
        words = words_of(text)
        if not words:
            return []
        wanted: dict[tuple[int, int], set[int]] = {}
        shared: dict[tuple[int, int], set[int]] = {}  # by shape, the items that share a shingle with the text
        for number, places in self._touched(words):
            _, size, k, _ = self.items[number]
            last = max(0, len(words) - size)
            starts = wanted.setdefault((size, k), set())
            shared.setdefault((size, k), set()).add(self.shapes[size, k][0][number])
            done = -1
            for place in places:
                low = max(done + 1, place - size + k, 0)
                done = max(done, min(place, last))
                starts.update(range(min(low, last), done + 1))
        best: dict[int, tuple[float, int]] = {}
        for (size, k), starts in wanted.items():
            _, numbers, prints, table = self.shapes[size, k]
            own, none = frozenset(shared[size, k]), frozenset()
            runs = np.split(order := np.array(sorted(starts)), np.flatnonzero(np.diff(order) > 1) + 1)
            for run in runs:  # neighbouring windows share their shingles
                first, stop = int(run[0]), int(run[-1]) + size
                shingles = _shingles(words[first:stop], k)
                width = min(size, len(words)) - k + 1
                if width < 1:
                    continue
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_bits(shingles), axis=0)])
                windows = _prints(sums[run - first + width] - sums[run - first])
                for at, window in zip((run - first).tolist(), windows, strict=True):
                    found = set().union(*(own & table[block].get(int(window[block]), none) for block in range(BLOCKS)))
                    for i in found:
                        if int(np.bitwise_count(window ^ prints[i]).sum()) <= RADIUS:
                            number = int(numbers[i])
                            similarity = _similarity(Counter(shingles[at : at + width]), self.items[number][3])
                            if similarity >= SIMILARITY and similarity > best.get(number, (0.0, 0))[0]:
                                best[number] = (similarity, first + at)
        return [(self.items[n][0], start, min(self.items[n][1], len(words)), s) for n, (s, start) in sorted(best.items())]


def _similarity(a: Counter, b: Counter) -> float:
    common = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return common / (a.total() + b.total() - common)


_BUILT: dict[str, Index] = {}


def _index(key: str, items: list) -> Index:
    """The index of a block of items, kept by the worker for its next tasks; only the newest one."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Index(items)
    return _BUILT[key]


def item_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS):
    """The items in lists of about ``block_chars`` characters."""
    items = benchmark.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield sorted(((r.item_id, r.text) for r in part.collect()), key=str)


def contaminations(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, first_word, n_words, similarity) for each benchmark item that a document contains."""
    spark, found = docs.sparkSession, None
    for items in item_blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared, key=uuid.uuid4().hex):
            index = _index(key, shared.value)
            for batch in pieces(batches):
                rows = [(d, *hit) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True) for hit in index.search(t)]
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "first_word", "n_words", "similarity"])

        part = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that contain no benchmark item, with the columns of ``docs``."""
    spark, schema, left = docs.sparkSession, docs.schema, docs
    for items in item_blocks(benchmark, block_chars):
        shared = spark.sparkContext.broadcast(items)

        def run(batches, shared=shared, key=uuid.uuid4().hex):
            index = _index(key, shared.value)
            for batch in pieces(batches):
                yield batch.filter(pa.array([not index.search(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        left = left.mapInArrow(run, schema)
    return left
