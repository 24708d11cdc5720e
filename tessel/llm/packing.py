"""Best-fit packing, planned over a histogram of lengths.

Documents become token ids; longer ones than the capacity are cut. A plan is made from the count of each length alone:
from the longest to the shortest, as many pieces of a length as there are go, best fit, into the open sequences with the
least room that suffices. Open sequences of equal room are ranges of numbers, so the plan is a short table of slot
ranges, whatever the number of documents; its size is bounded by the capacity. Pieces take their slots by their rank
within their length.

A rank is the rank within the part of the staged table that a piece was written in, counted there as it was
written, plus the pieces of that length in earlier parts. So no task ever holds all pieces of a length.

Edge cases: a null or empty text is one piece with the end id alone; texts longer than the capacity give full pieces and
a rest; repeated rows, and rows of null ids, are packed as often as they occur; an empty table gives an empty result; further columns of the
input are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tessel.llm.common import chunks, kept, staged, utf8

CAPACITY = 4096
END_ID = 1
#: Words whose ids a worker keeps: two generations of this many.
CACHED_WORDS = 400_000


#: Words of letters, digits and marks up to U+024F: none is composed or lower-cased otherwise than character by character.
_SIMPLE = re.compile("[\x21-\x7e\xa1-\u012f\u0131-\u024f]+")
#: The tokenizer's own pattern of pieces.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_WRITTEN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173]
#: The character for each byte in the vocabulary: its own if that is visible, and those from 256 on for the others in turn.
_BYTE_CHARS = {b: chr(b) for b in _WRITTEN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(_WRITTEN))}


def _bytes_of(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordTokenizer:
    """Ids of whole texts, put together from the ids of their words.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its words one after the other, and a
    word's are those of its pieces. Words and pieces recur; their ids are kept in two generations, the older of which is dropped when the newer is full.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self._encode = Tokenizer.from_file(path)
        self._special = {t.content: np.array([i], "<u4").tobytes() for i, t in self._encode.get_added_tokens_decoder().items()}
        self._literal = re.compile("|".join(["(" + "|".join(map(re.escape, self._special)) + ")"] if self._special else ["(?!)"]))
        self._encode.encode_special_tokens = True  # of what is left between them
        self._model = self._encode.model
        self._new: dict[bytes, bytes] = {}
        self._old: dict[bytes, bytes] = {}

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if _SIMPLE.fullmatch(text):
            pieces = _PIECE.findall(text.lower())
            if len(pieces) > 1:
                return b"".join([self.word(p.encode()) for p in pieces])
            if len(pieces) == 1:
                raw = pieces[0].encode()
                mapped = pieces[0] if raw.isascii() else "".join([_BYTE_CHARS[b] for b in raw])
                return _bytes_of([t.id for t in self._model.tokenize(mapped)])
        return _bytes_of(self._encode.encode(text, add_special_tokens=False).ids)

    def word(self, word: bytes) -> bytes:
        """Little-endian 32-bit ids of a word without ASCII white space or capitals."""
        if (ids := self._new.get(word)) is None:
            ids = self._old.get(word)
            if len(self._new) >= CACHED_WORDS:
                self._old, self._new = self._new, {}
            ids = self._new[word] = self._ids(word) if ids is None else ids
        return ids

    def ids(self, text: str) -> bytes:
        """Ids of a text as the tokenizer gives them: a special token that is written in it is one id."""
        if not any(t in text for t in self._special):
            return self.text(text)
        parts = self._literal.split(text)
        return b"".join(self._special.get(p) or self.text(p) for p in parts)

    def text(self, text: str) -> bytes:
        """Ids of a text without special tokens."""
        words = utf8(text).lower().split()
        get = self._new.get
        found = [*map(get, words)]
        try:
            return b"".join(found)
        except TypeError:  # a word isn't known yet
            return b"".join([self.word(w) if x is None else x for w, x in zip(words, found, strict=True)])


def tokenizer(path: str) -> WordTokenizer:
    return kept(f"tokenizer {path}", lambda: WordTokenizer(path))


def pieces(ids: bytes, capacity: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids, the end id added."""
    ids += int(END_ID).to_bytes(4, "little")
    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
        part = ids[at : at + 4 * capacity]
        yield k, at // 4, len(part) // 4, zlib.crc32(part)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, part_rank long"


def tokenized(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """A row per piece; part_rank counts the pieces of a length in a part from 0."""
    schema = T.StructType.fromDDL(PIECES)
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        part, encode = TaskContext.get().partitionId(), tokenizer(path).ids
        for batch in batches:
            rows = []
            for at, texts in chunks(batch, "text"):
                for doc, text in zip(batch.column("doc_id").slice(at, len(texts)).to_pylist(), texts, strict=True):
                    for k, start, n, crc in pieces(encode(text), capacity):
                        rows.append((doc, k, start, n, crc, part, int(seen[n])))
                        seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 7, types, strict=True)], names=schema.names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


Slot = tuple[int, int, int, int, int, int]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slot]:
    """Slot ranges (length, first rank, pieces, first sequence, pieces per sequence, first offset).

    Best-fit decreasing over counts. `room` holds, for each amount of room left, ranges of sequences; a length's pieces
    take the ranges of least room first, each as many to a sequence as fit there, as single best-fit steps would.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    slots: list[Slot] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        left_over: list[tuple[int, tuple[int, int]]] = []
        for r in range(length, capacity + 1):
            while left and room[r]:
                first, n = room[r].pop()
                each = r // length
                take = min(n, -(-left // each))
                put = min(left, take * each)
                slots.append((length, rank, put, first, each, capacity - r))
                full = put // each
                if full:
                    left_over.append((r - each * length, (first, full)))
                if put % each:
                    left_over.append((r - put % each * length, (first + full, 1)))
                if take < n:
                    room[r].append((first + take, n - take))
                rank, left = rank + put, left - put
            if not left:
                break
        if left:
            each = capacity // length
            take = -(-left // each)
            slots.append((length, rank, left, opened, each, 0))
            full = left // each
            if full:
                left_over.append((capacity - each * length, (opened, full)))
            if left % each:
                left_over.append((capacity - left % each * length, (opened + full, 1)))
            opened += take
        for r, span in left_over:
            room[r].append(span)
    return slots


def pack(pieces_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with sequence_id and offset. pieces_table must be staged: its parts and ranks are read twice."""
    per_part = pieces_table.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = plan(counts, capacity)
    before = F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_part.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = pieces_table.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("part_rank"))
    return _take_slots(ranked, slots)


def _take_slots(ranked: DataFrame, slots: list[Slot]) -> DataFrame:
    """Each piece with the slot that its rank within its length falls into.

    The plan is broadcast: its ranges number a few for each length up to the capacity, however many pieces there are.
    """
    schema = T.StructType.fromDDL("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    shipped = ranked.sparkSession.sparkContext.broadcast(np.array(sorted(slots), np.int64).reshape(-1, 6))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shipped.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                own = length == n
                lo, hi = np.searchsorted(ranges[:, 0], [n, n + 1])
                at[own] = lo + np.searchsorted(ranges[lo:hi, 1], rank[own], side="right") - 1
            _, from_rank, _, sequence, each, offset = ranges[at].T
            k = rank - from_rank
            columns = [batch.column(c) for c in schema.names[:5]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence + k // each), pa.array(offset + k % each * length)], names=schema.names)

    return ranked.select(*schema.names[:5], "rank").mapInArrow(run, schema)


def pack_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    return pack(staged(tokenized(docs, path, id_col=id_col, text_col=text_col, capacity=capacity), "pieces"), capacity)


def tokenizer_path(spark: SparkSession, name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's file; it is the same on every node."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
