"""SimHash near-duplicates by anchor-point covering.

Fingerprint (64 bits): lower-case A-Z, words ``[^\\x20\\x09-\\x0D]+``, three-word shingles with repeats, XXH64
(seed 42) of each; a bit is 1 if it is set in over half of the hashes.  Fewer than three words: the whole sequence
is the one shingle; no word (or a null text): fingerprint zero, which links like any other.

Search for all pairs within three bits.  The 64 bits are two halves of 32; of three differing bits at most one
falls in one of the halves (threshold one there).  Anchors of a half are the words of a covering code of radius one:
the perfect Hamming code on 31 bits with one free bit, 2^27 anchors.  Each fingerprint is replicated to every
anchor within covering radius plus threshold, two bits: at most 17 of each half.  Take a pair that differs in one
bit of a half: the anchor nearest to the one is within two bits of the other, so they meet there.  The guarantee is
exact for any data, and an anchor collects 2^-27 of all fingerprints on average.

Exact copies are one fingerprint before the search.  What meets at an anchor is compared in a stream over the
sorted partition; a crowded anchor is split by the other half's bytes and passes on a spanning forest of its links, never all
pairs, and components are the same.

Defined results: null or blank text -> fingerprint zero; null ``doc_id`` rows keep their fingerprint and never
lend their id to a component; repeated rows share a component; an empty table gives an empty table; further
columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnframe.durable import written
from dawnframe.llm.arrow import add_columns
from dawnframe.llm.graph import connected_components

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 3
#: Shingles hashed at once; bounds the memory of a very long text.
BLOCK = 32768


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint as a signed integer."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    wide = min(SHINGLE_WORDS, len(words))
    first, last = starts[: len(words) - wide + 1].tolist(), ends[wide - 1 :].tolist()
    digest, view = xxhash.xxh64_intdigest, memoryview(joined)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(first), BLOCK):
        part = zip(first[at : at + BLOCK], last[at : at + BLOCK], strict=True)
        hashes = np.array([digest(view[a:b], SEED) for a, b in part], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(first))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with its text column replaced by ``fingerprint`` (long)."""
    return add_columns(docs, text, [("fingerprint", T.LongType(), pa.int64())], lambda: lambda x: (fingerprint(x),))


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All anchors within two bits of each 32-bit value: (index of the value, anchor).

    Bits 0 to 30 hold positions 1 to 31 of the Hamming code, whose syndrome is the XOR of the set positions;
    bit 31 is free.
    """
    syndrome = np.zeros(len(half), np.int64)
    for place in range(1, 32):
        syndrome ^= np.where((half >> (place - 1)) & 1, place, 0)
    flip = np.where(syndrome > 0, np.int64(1) << np.maximum(syndrome - 1, 0), 0)
    index = np.arange(len(half))
    found = [(index, half ^ flip), (index, half ^ flip ^ (np.int64(1) << 31))]
    for place in range(1, 32):  # the two flipped positions XOR to the syndrome; each pair is taken once
        other = syndrome ^ place
        use = (syndrome > 0) & (other > place)
        found.append((index[use], half[use] ^ (np.int64(1) << (place - 1)) ^ (np.int64(1) << (other[use] - 1))))
    return np.concatenate([i for i, _ in found]), np.concatenate([a for _, a in found])


def replicas(prints: DataFrame) -> DataFrame:
    """(anchor, fingerprint): each fingerprint at every anchor within two bits, for both halves."""

    def run(batches):
        for batch in batches:
            values = batch.column("fingerprint").to_numpy(zero_copy_only=False).astype(np.int64)
            for side, half in enumerate(((values >> 32) & 0xFFFFFFFF, values & 0xFFFFFFFF)):
                index, anchor = anchors_of(half)
                yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchor | (side << 32), pa.int64()), "fingerprint": pa.array(values[index], pa.int64())})

    return prints.select("fingerprint").mapInArrow(run, "anchor long, fingerprint long")


#: Up to so many fingerprints an anchor passes on each of its links; beyond, a spanning forest of them.
SMALL = 16
#: An anchor with more fingerprints is split by the four bytes of their other half: of at most three differing bits none falls in one of them.
CROWDED = 2048


def _links(keys: np.ndarray, values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between values under equal keys (both sorted by key)."""
    edge = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], edge])
    sizes = np.diff(np.concatenate([starts, [len(keys)]]))
    left, right = [], []
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    k, v = keys[small], values[small]
    for gap in range(1, SMALL):
        same = np.flatnonzero(k[gap:] == k[:-gap]) if len(k) > gap else np.empty(0, np.int64)
        if not len(same):
            break
        near = same[np.bitwise_count(v[same] ^ v[same + gap]) <= radius]
        left.append(v[near])
        right.append(v[near + gap])
    for at, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        for part in _split(values[at : at + size], int(keys[at])):
            a, b = _forest(part, radius)
            left.append(a)
            right.append(b)
    return np.concatenate([*left, np.empty(0, np.int64)]), np.concatenate([*right, np.empty(0, np.int64)])


def _split(values: np.ndarray, anchor: int):
    """The fingerprints of an anchor, in parts such that every link lies within some part."""
    if len(values) <= CROWDED:
        yield values
        return
    other = 32 if anchor >> 32 else 0  # the anchor covers one half; this is where the other one starts
    for shift in range(other, other + 32, 8):
        byte = (values >> shift) & 0xFF
        order = np.argsort(byte, kind="stable")
        yield from (p for p in np.split(values[order], np.flatnonzero(np.diff(byte[order])) + 1) if len(p) > 1)


def _forest(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of one anchor, by breadth-first search over what is not reached yet."""
    rest, left, right = values, [], []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            value = queue.pop()
            near = np.bitwise_count(rest ^ value) <= radius
            if near.any():
                got = rest[near]
                left.append(np.full(len(got), value))
                right.append(got)
                queue += list(got)
                rest = rest[~near]
    return np.concatenate([*left, np.empty(0, np.int64)]), np.concatenate([*right, np.empty(0, np.int64)])


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b: enough of the links within ``radius`` (at most three) to have all components right."""
    met = replicas(prints).repartition("anchor").sortWithinPartitions("anchor")

    def run(batches):
        keys, values = [], []  # the last anchor seen so far, which the next batch may continue

        def flush(k, v):
            a, b = _links(np.concatenate(k), np.concatenate(v), radius)
            return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

        for batch in batches:
            k = batch.column("anchor").to_numpy(zero_copy_only=False)
            v = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            if not len(k):
                continue
            cut = int(np.searchsorted(k, k[-1]))
            if cut == 0 and (not keys or keys[-1][-1] == k[-1]):
                keys.append(k)
                values.append(v)
                continue
            yield flush([*keys, k[:cut]], [*values, v[:cut]])
            keys, values = [k[cut:].copy()], [v[cut:].copy()]
        if keys:
            yield flush(keys, values)

    return met.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: ``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (least id reachable)."""
    prints = written(fingerprints(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))), "simhash")
    groups = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "simhash-groups")
    members = connected_components(links(groups))
    roots = members.join(groups, members.node == groups.fingerprint).select("node", "root", "first_id")
    least = roots.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("fingerprint"), "component_id")
    of_print = groups.join(linked, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first_id").alias("component_id"))
    joined = prints.join(written(of_print, "simhash-components"), "fingerprint", "left")  # both sides shuffled as they are read: skewed partitions can be split
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component: a row of its least id.  Rows with a null id stay.

    An id may name several documents, so what stays is a (doc_id, fingerprint), of repeated rows one.  Texts meet only the ids
    that lose a row; these are written first, so that Spark knows their size and broadcasts them where they are few.
    """
    found = near_duplicates(docs.select("doc_id", "text")).where(F.col("doc_id").isNotNull())
    stays = F.col("component_id") == F.col("doc_id")
    by_id = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.when(stays, F.col("fingerprint"))).alias("kept_print"))
    losers = written(by_id.where("n > 1 or kept_print is null").select("doc_id", "kept_print"), "simhash-losers")
    rest = docs.join(losers.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    shared = losers.where(F.col("kept_print").isNotNull())  # ids with several rows, one of which stays
    if shared.isEmpty():
        return rest
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.join(shared.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.struct(*columns).alias("row"), F.col("text").alias("text"))
    printed = fingerprints(rows).select("doc_id", "row", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("print"))
    own = printed.join(shared.withColumnRenamed("kept_print", "print"), ["doc_id", "print"])
    one = own.groupBy("doc_id").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return rest.unionByName(one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns]))
