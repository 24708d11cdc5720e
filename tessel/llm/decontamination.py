"""Benchmark decontamination: which documents hold a benchmark item, exactly or nearly.

Windows of a document that are as long as an item, in words, get 128-bit SimHash fingerprints of their word shingles. The
fingerprints of the items of a length are split into 16 blocks of 8 bits: fingerprints within RADIUS differ by at most
RADIUS // 16 bits in one block at least, so an item is looked at whose bits in one block are that near to a window's, and
no item within RADIUS is missed. Items so found, and within RADIUS as a whole, are verified by the exact
similarity of shingles weighted by how often they occur: sum of minima over sum of maxima, at least 0.75.

A window of that similarity holds six in seven of the item's shingles. So windows with fewer places of shingles of any item are
left out, and all others are fingerprinted, whatever they hold; the fingerprints' radius lies some four standard deviations beyond the distance expected at similarity 0.75.

Items are shipped to executors in blocks of ITEMS; more items mean more passes.

Edge cases: null and empty texts and items match nothing; items under five words are one shingle of their own length; a
document shorter than an item is one window; repeated documents and items give a row each, and so do null ids; of several windows the
most similar, then the first, is returned; empty tables give an empty result; further columns, of documents and of items, are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessel.llm.common import chunks, drop_kept, mix, words_of
from tessel.llm.shingles import K, shingle_hashes

ITEMS = 1 << 16
RADIUS = 40
N_BLOCKS = 16
#: Bits of the gate's places: some 16 places a shingle within these limits.
_LEAST_GATE, _MOST_GATE = 12, 24
#: Places whose bits are summed at once, and cells of tables of windows by items.
_PLACES, _CELLS = 4096, 1 << 22


@dataclass
class Group:
    """Items of one length."""

    items: np.ndarray
    prints: np.ndarray  # (item, N_BLOCKS) bytes


@dataclass
class Index:
    ids: list[int]
    bounds: np.ndarray  # of each item's places in shingles and times
    shingles: np.ndarray  # an item's different shingles, ascending
    times: np.ndarray
    groups: dict[int, Group]  # by length in words
    known: dict[int, np.ndarray]  # by size in words, the shingles of all items, ascending
    gate: np.ndarray  # by a shingle's last bits, whether an item may hold it


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    """128 signs of sums over shingles of their hashes' bits; a zero sum counts as positive."""
    halves = np.stack([shingles, mix(shingles + np.uint64(1))], 1)
    bits = np.unpackbits(np.ascontiguousarray(halves).view(np.uint8).reshape(len(shingles), 16), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) >= len(shingles))


def fingerprints(shingles: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the windows of n shingles at ascending starts, by sums of bits up to each place."""
    out = np.empty((len(starts), N_BLOCKS), np.uint8)
    done = 0
    while done < len(starts):
        first = int(starts[done])
        stop = max(done + 1, int(np.searchsorted(starts, first + _PLACES)))
        own = shingles[first : int(starts[stop - 1]) + n]
        halves = np.stack([own, mix(own + np.uint64(1))], 1)
        sums = np.zeros((len(own) + 1, 128), np.int32)
        np.cumsum(np.unpackbits(halves.view(np.uint8).reshape(len(own), 16), axis=1), axis=0, dtype=np.int32, out=sums[1:])
        at = starts[done:stop] - first
        out[done:stop] = np.packbits(2 * (sums[at + n] - sums[at]) >= n, axis=1)
        done = stop
    return out


def build(items: list[tuple[int, str]]) -> Index:
    ids, shingles, times = [], [], []
    by_length: defaultdict[int, list[tuple[int, np.ndarray]]] = defaultdict(list)
    known: defaultdict[int, list[np.ndarray]] = defaultdict(list)
    for item, text in items:
        words = words_of([text or ""]).hashes
        if not len(words):
            continue
        own = shingle_hashes(words)
        by_length[len(words)].append((len(ids), fingerprint(own)))
        known[min(len(words), K)].append(own)
        ids.append(item)
        for held, part in zip((shingles, times), np.unique(own, return_counts=True), strict=True):
            held.append(part)
    groups = {n: Group(np.array([i for i, _ in own]), np.array([p for _, p in own], np.uint8)) for n, own in by_length.items()}
    sets = {size: np.unique(np.concatenate(own)) for size, own in known.items()}
    gate = np.zeros(1 << min(_MOST_GATE, max(_LEAST_GATE, (16 * sum(map(len, sets.values()))).bit_length())), bool)
    for own in sets.values():
        gate[(own & np.uint64(len(gate) - 1)).astype(np.int64)] = True
    bounds = np.cumsum([0, *map(len, shingles)])
    return Index(ids, bounds, np.concatenate([np.zeros(0, np.uint64), *shingles]), np.concatenate([np.zeros(0, np.int64), *times]), groups, sets, gate)


#: For each byte, whether so many of its bits are set as one block may differ in at most.
_NEAR = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1) <= RADIUS // N_BLOCKS


def within(group: Group, marks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(window, item, distance) of the items within RADIUS of each window's fingerprint, by window."""
    each = max(1, _CELLS // (N_BLOCKS * len(group.items)))
    for i in range(0, len(marks), each):
        some = marks[i : i + each]
        w, g = np.nonzero(_NEAR[some[:, None] ^ group.prints[None]].any(2))
        apart = np.unpackbits(some[w] ^ group.prints[g], axis=1).sum(1)
        keep = apart <= RADIUS
        yield from zip((w[keep] + i).tolist(), group.items[g[keep]].tolist(), apart[keep].tolist(), strict=True)


def weighted_similarity(index: Index, item: int, window: np.ndarray) -> float:
    """Of an item and a window's shingles: the sum of the lesser counts over that of the greater ones."""
    own = slice(index.bounds[item], index.bounds[item + 1])
    shingles, times = index.shingles[own], index.times[own]
    found, n = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(shingles, found), len(shingles) - 1)
    both = int(np.minimum(times[at], n)[shingles[at] == found].sum())
    return both / (len(window) + int(times.sum()) - both)


def search(index: Index, words: np.ndarray, least: float = 0.75) -> list[tuple[int, float, int, int, int]]:
    """(item, similarity, hamming, first word, words) of the best window of each item found in a text's word hashes."""
    best: dict[int, tuple[float, int, int, int]] = {}
    for size, known in index.known.items():
        if len(words) < size:
            continue
        own = shingle_hashes(words, size)
        at = np.flatnonzero(index.gate[(own & np.uint64(len(index.gate) - 1)).astype(np.int64)])
        at = at[known[np.minimum(np.searchsorted(known, own[at]), len(known) - 1)] == own[at]]
        if not len(at):
            continue
        for length, group in index.groups.items():
            if min(length, K) != size:
                continue
            held, shingles = min(length, len(words)) - size + 1, length - size + 1
            need = max(1, math.ceil(least * (held + shingles) / (1 + least) - 1e-9))
            if need > held or len(at) < need:
                continue
            starts = starts_of(at, need, held, len(own) - held)
            for i, item, hamming in within(group, fingerprints(own, starts, held)) if len(starts) else ():
                start = int(starts[i])
                similarity = weighted_similarity(index, item, own[start : start + held])
                if similarity >= least and similarity > best.get(item, (0,))[0]:
                    best[item] = (similarity, hamming, start, min(length, len(words)))
    return [(item, *best[item]) for item in sorted(best)]


def starts_of(hits: np.ndarray, need: int, size: int, last: int) -> np.ndarray:
    """Starts up to `last` of all windows of `size` places that hold `need` of the sorted hits at least."""
    a, z = hits[: len(hits) - need + 1], hits[need - 1 :]
    lo, hi = np.maximum(z - size + 1, 0), np.minimum(a, last)
    n = np.maximum(hi - lo + 1, 0)
    return np.unique(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()))


OUT = "doc_id long, item_id long, similarity double, hamming int, start_word int, n_words int"


def _search_block(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    schema = T.StructType.fromDDL(OUT)
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
    shipped = docs.sparkSession.sparkContext.broadcast(build(items))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        index = shipped.value
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                w = words_of(texts)
                ids = batch.column("doc_id").slice(at, len(texts)).to_pylist()
                stops = np.cumsum(w.counts)
                rows = [
                    (doc, index.ids[item], *rest)
                    for doc, stop, n in zip(ids, stops.tolist(), w.counts.tolist(), strict=True)
                    if n
                    for item, *rest in search(index, w.hashes[stop - n : stop])
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, types, strict=True)], names=schema.names)

    return docs.mapInArrow(run, schema)


def contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per document and item that it holds; a pass over docs for each ITEMS items, no shuffle."""
    items = items.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    n_blocks = max(1, -(-items.count() // ITEMS))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    parts = [_search_block(docs, sorted((tuple(r) for r in items.where(block == b).collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))) for b in range(n_blocks)]
    return reduce(DataFrame.unionByName, parts)
