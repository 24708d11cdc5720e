"""N-gram Jaccard join: which documents share at least three quarters of their word shingles, and the groups they form.

The sparse matrix of documents by shingles is multiplied with its transpose, block by block of shingles, and only as far
as the sizes demand. Documents with equal sets are one row (a class). Shingles have one order: rare ones by their hash,
then frequent ones by their count. Two sets of n and m shingles that link share one of their first
n - ceil(3n/4) + 1 and m - ceil(3m/4) + 1 shingles (their heads), so only heads are multiplied:

1. One pass counts every shingle, in blocks of hash ranges, and keeps the frequent ones: those whose count is at least
   the least power of two, from MIN_FREQUENT on, that at most MOST_FREQUENT shingles reach. The order is exact
   whichever they are; they only keep the product sparse.
2. The blocks' products over rare head shingles give partial overlaps of pairs, summed over blocks; a pair whose sum
   and remaining sizes cannot reach the overlap that its sizes demand is discarded. A rare shingle that LONG_LIST classes
   hold in their heads, as there may be where more than MOST_FREQUENT shingles are frequent, is left out of the product
   and handled as a frequent one.
3. Over a frequent head shingle, members are compared with one pivot, then with a second one, then, where a list still
   has several components, members of different components with each other. Jaccard distance is a metric, so two
   members whose distances from the pivot differ by more than 1/4 need no comparison. So a large group of near
   copies costs a few comparisons a member, and still no link between components is lost.
4. Remaining pairs are verified on their whole sets.

Edge cases: null and empty texts have no shingle and link with nothing; texts under five words are one shingle; repeated
rows and equal sets are one class; a null id takes part, but is no component's name; very long texts are handled
whole; an empty table gives an empty result; further columns of the input are ignored. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.llm.bloom import holds, key_filter
from tessel.llm.common import chunks, drop_kept, mix, packed, release, return_memory, staged, unpacked
from tessel.llm.components import components
from tessel.llm.shingles import set_key, shingle_sets

MIN_FREQUENT = 32
MOST_FREQUENT = 1 << 20
#: Classes with one rare shingle in their heads from which on it is handled as a frequent one.
LONG_LIST = 256
_U8, _U4 = "<u8", "<u4"
_U4_ZERO = np.zeros(1, _U4)[0]
_POSITIVE = (1 << 62) - 1


def head_size(n: np.ndarray | int) -> np.ndarray | int:
    return n - -(-3 * n // 4) + 1


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _blocks(values: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """Places of each block of ascending hashes, a block being a range of their first `bits` bits."""
    tops = (values >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(tops)) + 1
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(tops)], strict=True):
        if b > a:
            yield int(tops[a]), slice(a, b)


# 1: classes and counts


def _count_rows(bits: int, rows: int = 1 << 20):
    """Ids, set sizes and set keys; and by block the distinct shingles with their counts, about `rows` at once."""
    schema = pa.schema([("block", pa.int64()), ("low", pa.binary()), ("n", pa.binary()), ("keys", pa.binary()), ("ids", pa.list_(pa.int64()))])

    def out(block: list, low: list, n: list, keys: list, ids: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip((block, low, n, keys, ids), schema, strict=True)], schema=schema)

    def flush(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        values, times = np.unique(np.concatenate(held), return_counts=True)
        for block, at in _blocks(values, bits):
            low = (values[at] >> np.uint64(32 - bits)).astype(_U4)
            yield out([block], [packed(np.diff(low, prepend=_U4_ZERO))], [times[at].astype(_U4).tobytes() if times[at].max() > 1 else b""], [b""], [[]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        held, size = [], 0
        for batch in batches:
            for at, texts in chunks(batch, "text"):
                sets = shingle_sets(texts)
                n = np.array([len(s) for s in sets], _U4)
                keys = np.array([set_key(s) for s in sets], "<i8")
                yield out([-1 - (int(keys[0]) & _POSITIVE)], [b""], [n.tobytes()], [keys.tobytes()], [batch.column("doc_id").slice(at, len(texts)).to_pylist()])
                held += sets
                size += int(n.sum())
                if size >= rows:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)
        held = None
        return_memory()

    return run


def _count_block(bits: int):
    schema = pa.schema([("frequent", pa.bool_()), ("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, lows, times = key[0].as_py(), [], []
        for table in batches:
            if block < 0:
                for n, keys, ids in zip(*(table.column(c) for c in ("n", "keys", "ids")), strict=True):
                    n, keys = np.frombuffer(n.as_py(), _U4).astype(np.int64), np.frombuffer(keys.as_py(), "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(n), bool)), ids.values, pa.array(n), pa.array(keys)], schema=schema)
                continue
            for low, n in zip(table.column("low"), table.column("n"), strict=True):
                lows.append(np.cumsum(unpacked(low.as_py(), _U4), dtype=_U4))
                times.append(np.frombuffer(n.as_py(), _U4) if len(n.as_py()) else np.ones(len(lows[-1]), _U4))
        if lows:
            values, of = np.unique(np.concatenate(lows), return_inverse=True)
            count = np.bincount(of, np.concatenate(times)).astype(np.int64)
            big = np.flatnonzero(count >= MIN_FREQUENT)
            hashes = (np.uint64(block) << np.uint64(32)) | values[big].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(big), bool)), pa.nulls(len(big), pa.int64()), pa.array(count[big]), pa.array(hashes.view(np.int64))], schema=schema)

    return run


def _frequent(counted: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles' hash beginnings, ascending, and their counts: at most `most`."""
    found = counted.where("frequent").select(F.col("key").alias("hash"), F.col("n").alias("n"))
    level = F.floor(F.log2("n")).cast("int").alias("level")
    sizes = sorted(((r["level"], r["count"]) for r in found.groupBy(level).count().collect()), reverse=True)
    least, total = 64, 0
    for lv, n in sizes:
        total += n
        if total > most:
            break
        least = lv
    got = found.where(F.col("n") >= (1 << least)).toArrow() if least < 63 else None
    if got is None or not got.num_rows:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h, n = got.column("hash").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


# 2: the product over heads


def _head(s: np.ndarray, bits: int, frequent: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rare, then the frequent shingles among the first ones of a set."""
    p = int(head_size(len(s)))
    if not len(frequent):
        return s[:p], s[:0]
    short = s >> np.uint64(32 - bits)
    at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
    often = frequent[at] == short
    rare = s[~often][:p]
    if len(rare) == p:
        return rare, s[:0]
    some, n = s[often], counts[at[often]]
    return rare, some[np.lexsort((some, n))][: p - len(rare)]


def _product_rows(bits: int, block_bits: int, shipped, rows: int = 1 << 19):
    """Head entries by block: shingle, row of the class table beside them. Blocks under 0: entries of frequent shingles.

    Heads hold the least hashes, so blocks are ranges of the hashes mixed anew. Of a mixed hash 32 bits beyond the block go on: what
    two shingles have in common by chance can only bring a pair too many, which is then verified.
    """
    schema = pa.schema([("block", pa.int64()), ("shingle", pa.binary()), ("row", pa.binary()), ("classes", pa.binary())])

    def out(block: int, *parts: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([p], pa.binary()) for p in parts)], schema=schema)

    def flush(held: list[tuple[int, int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        table = np.array([(k, n, len(r)) for k, n, r, _ in held], "<i8")
        rare = mix(np.concatenate([r for _, _, r, _ in held]))
        row = np.repeat(np.arange(len(held), dtype=_U4), [len(r) for _, _, r, _ in held])
        order = np.argsort(rare)
        rare, row = rare[order], row[order]
        for block, at in _blocks(rare, block_bits) if len(rare) else ():
            some, local = np.unique(row[at], return_inverse=True)
            low = (rare[at] >> np.uint64(32 - block_bits)).astype(_U4)
            yield out(block, packed(np.diff(low, prepend=_U4_ZERO)), packed(local.astype(_U4)), table[some].tobytes())
        often = [(i, f) for i, (_, _, _, f) in enumerate(held) if len(f)]
        if often:
            rows = np.repeat([i for i, _ in often], [len(f) for _, f in often])
            some, local = np.unique(rows, return_inverse=True)
            yield out(-1 - (int(table[0, 0]) & _POSITIVE), np.concatenate([f for _, f in often]).astype(_U8).tobytes(), local.astype(_U4).tobytes(), table[some].tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        frequent, counts = shipped.value
        held, size = {}, 0  # by key: equal sets that meet here are one, others in the block
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                for s in shingle_sets(texts):
                    if not len(s) or (key := set_key(s)) in held:
                        continue
                    rare, often = _head(s, bits, frequent, counts)
                    held[key] = (key, len(s), rare, often)
                    size += len(rare) + len(often)
                if size >= rows:
                    yield from flush([*held.values()])
                    held, size = {}, 0
        if held:
            yield from flush([*held.values()])
        held = None
        return_memory()

    return run


_PAIR = ["u", "v", "n_u", "n_v", "rare_u", "rare_v", "shared"]


def _pair_batch(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=_PAIR)


def _pairs(shingle: np.ndarray, cls: np.ndarray, table: np.ndarray, block: int, long_list: int) -> Iterator[pa.RecordBatch]:
    """Pairs of classes (u < v) with the shingles shared in a block, sizes and rare heads; incompatible sizes are left out.

    cls are rows of table (key, size, rare), which is sorted by key. Lists of long_list classes give an entry each instead.
    """
    order = np.lexsort((cls, shingle))
    shingle, cls = shingle[order], cls[order]
    keep = np.concatenate([[True], (np.diff(shingle) != 0) | (np.diff(cls) != 0)]) if len(cls) else np.zeros(0, bool)
    shingle, cls = shingle[keep], cls[keep]
    first = np.flatnonzero(np.concatenate([[True], np.diff(shingle) != 0])) if len(cls) else np.zeros(0, np.int64)
    size = np.repeat(np.diff(np.concatenate([first, [len(cls)]])), np.diff(np.concatenate([first, [len(cls)]])))
    long = size >= long_list
    if long.any():
        h = (np.int64(block) << 32) | shingle[long].astype(np.int64)
        zero = np.zeros(len(h), np.int64)
        yield _pair_batch(h, table[cls[long], 0], table[cls[long], 1], zero, zero, zero, zero - 1)
    some = (size > 1) & ~long
    shingle, cls = shingle[some], cls[some]
    n, code = table[:, 1], []
    at = np.arange(len(shingle))
    for d in range(1, long_list):
        at = at[at + d < len(shingle)]
        at = at[shingle[at] == shingle[at + d]]
        if not len(at):
            break
        a, b = cls[at].astype(np.int64), cls[at + d].astype(np.int64)
        ok = 4 * np.minimum(n[a], n[b]) >= 3 * np.maximum(n[a], n[b])
        code.append((a[ok] << 32) | b[ok])
    if code:
        code, shared = np.unique(np.concatenate(code), return_counts=True)
        for i in range(0, len(code), 1 << 18):
            u, v = table[code[i : i + (1 << 18)] >> 32], table[code[i : i + (1 << 18)] & 0xFFFFFFFF]
            yield _pair_batch(u[:, 0], v[:, 0], u[:, 1], v[:, 1], u[:, 2], v[:, 2], shared[i : i + (1 << 18)])


def _product_block(long_list: int):
    """Partial overlaps (u, v, n_u, n_v, rare_u, rare_v, shared) of a block; or entries (shingle, class, size, 0, rare, place, 0).

    Entries of a rare shingle's long list are shared = -1, and claim nothing of rare shingles and place.
    """

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, shingles, rows, tables, n = key[0].as_py(), [], [], [], 0
        for batch in batches:
            for s, row, classes in zip(*(batch.column(c) for c in ("shingle", "row", "classes")), strict=True):
                table = np.frombuffer(classes.as_py(), "<i8").reshape(-1, 3)
                if block < 0:  # a class's frequent shingles follow one another, behind its rare ones
                    row = np.frombuffer(row.as_py(), _U4)
                    of = table[row]
                    place = of[:, 2] + np.arange(len(row)) - np.searchsorted(row, row)
                    zero = np.zeros(len(row), np.int64)
                    yield _pair_batch(np.frombuffer(s.as_py(), _U8).view(np.int64), of[:, 0], of[:, 1], zero, of[:, 2], place, zero)
                    continue
                shingles.append(np.cumsum(unpacked(s.as_py(), _U4), dtype=_U4))
                rows.append(unpacked(row.as_py(), _U4) + _U4_ZERO.dtype.type(n))
                tables.append(table)
                n += len(table)
        if shingles:
            table = np.concatenate(tables)
            _, first, of = np.unique(table[:, 0], return_index=True, return_inverse=True)
            shingle, cls = np.concatenate(shingles), of.astype(_U4)[np.concatenate(rows)]
            shingles = rows = tables = None
            yield from _pairs(shingle, cls, table[first], block, long_list)
        return_memory()

    return run


# 3 and 4: sets of candidates, verification


def _set_rows(shipped):
    """Key and set of each text that the filter lets pass, equal ones of a chunk once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        words = shipped.value
        for batch in batches:
            for _, texts in chunks(batch, "text"):
                sets = {set_key(s): s for s in shingle_sets(texts) if len(s)}
                passed = holds(words, np.fromiter(sets, np.int64, len(sets)))
                found = {key: s.astype(_U8).tobytes() for (key, s), ok in zip(sets.items(), passed.tolist(), strict=True) if ok}
                yield pa.RecordBatch.from_arrays([pa.array([*found], pa.int64()), pa.array([*found.values()], pa.binary())], names=["key", "data"])
        return_memory()

    return run


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(u, v, n_u, n_v, shared) of pairs (u, v), from whole sets."""
    a = sets.select(F.col("key").alias("u"), F.col("data").alias("a"))
    b = sets.select(F.col("key").alias("v"), F.col("data").alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x, y in zip(batch.column("a"), batch.column("b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), _U8), np.frombuffer(y.as_buffer(), _U8)
                at = np.searchsorted(y, x)
                rows.append((len(x), len(y), int((y[np.minimum(at, len(y) - 1)] == x).sum())))
            cols = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), *(pa.array(c, pa.int64()) for c in cols)], names=["u", "v", "n_u", "n_v", "shared"])

    return pairs.select("u", "v").join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long, n_u long, n_v long, shared long")


_LINKED = "7 * shared >= 3 * (n_u + n_v)"
#: Of two members of a frequent shingle's list, all rare shingles are in the heads. If they share a rare one, the product has the
#: pair; if not, they share frequent ones alone, of which the one with fewer must have enough.
_COMPATIBLE = "4 * least(n_u, n_v) >= 3 * greatest(n_u, n_v) AND 7 * least(n_u - rare_u, n_v - rare_v) >= 3 * (n_u + n_v)"


def _pivot(*columns: str) -> Column:
    """The member with the fewest rare shingles: copies of one text differ least from the one that has the least of its own."""
    return F.min(F.struct("rare", "key", "n", *columns)).alias("p")


def _against_pivot() -> dict[str, Column]:
    return {"n_u": F.col("n"), "n_v": F.col("p.n"), "rare_u": F.col("rare"), "rare_v": F.col("p.rare")}
#: If this is the first shingle in the common order that two sets share, they share no more than what stands from here on.
_REACH = "7 * least(n_u - place_u, n_v - place_v) >= 3 * (n_u + n_v)"


def _ordered(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _with_labels(members: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    label = components(links, parts)
    return members.join(label, members["key"] == label["node"], "left").select("h", "key", "n", "rare", "place", F.coalesce("component", "key").alias("label"))


def _star_pairs(labelled: DataFrame, parts: int) -> DataFrame:
    """Each member of a list with a second pivot, the least member of those in another component than the first, if it isn't in its component."""
    least = labelled.groupBy("h", "label").agg(F.min(F.struct("rare", "key", "n", "label")).alias("p"))
    second = least.withColumn("place", F.row_number().over(W.partitionBy("h").orderBy("p"))).where("place <= 2")
    other = staged(second.where("place = 2").select("h", "p"), "pivots", parts)
    joined = labelled.join(other, "h").where("label <> p.label")
    return joined.withColumns(_against_pivot()).where(_COMPATIBLE).select(*_ordered("key", "p.key")).distinct()


def jaccard_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", most_frequent: int = MOST_FREQUENT, long_list: int = LONG_LIST) -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of every row of docs."""
    source = _documents(docs, id_col, text_col)
    words = (source.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // 6
    bits = min(30, max(4, (words >> 20).bit_length()))
    block_bits = max(3, bits - 1)
    parts = max(24, 1 << bits)  # files of a staged table at most: one for each million words
    rows = source.mapInArrow(_count_rows(bits), "block long, low binary, n binary, keys binary, ids array<long>")
    counted = staged(rows.groupBy("block").applyInArrow(_count_block(bits), "frequent boolean, doc_id long, n long, key long"), "counted", parts)
    base = counted.where("not frequent").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("key")).alias("key"))

    shipped = source.sparkSession.sparkContext.broadcast(_frequent(counted, most_frequent))
    entries = source.mapInArrow(_product_rows(bits, block_bits, shipped), "block long, shingle binary, row binary, classes binary")
    product = staged(
        entries.groupBy("block").applyInArrow(_product_block(long_list), "u long, v long, n_u long, n_v long, rare_u long, rare_v long, shared long"), "product", parts
    )
    members = product.where("shared <= 0").select(F.col("u").alias("h"), F.col("v").alias("key"), F.col("n_u").alias("n"), F.col("rare_u").alias("rare"), F.col("rare_v").alias("place")).distinct()
    members = staged(members, "members", parts)
    summed = product.where("shared > 0").groupBy("u", "v").agg(*(F.first(c).alias(c) for c in ("n_u", "n_v", "rare_u", "rare_v")), F.sum("shared").alias("shared"))
    long = product.where("shared < 0").groupBy(F.col("v").alias("key")).agg(F.count(F.lit(1)).alias("long"))
    if not long.isEmpty():  # shingles of long lists are no part of the sums, as if they stood behind the heads
        for side in ("u", "v"):
            summed = summed.join(long.withColumnRenamed("key", side), side, "left").withColumn(f"rare_{side}", F.col(f"rare_{side}") - F.coalesce("long", F.lit(0))).drop("long")
    # the shingles behind the shorter of two heads in the common order are at most those behind either
    reach = "7 * (shared + greatest(n_u - rare_u, n_v - rare_v)) >= 3 * (n_u + n_v)"
    pivots = staged(members.groupBy("h").agg(_pivot()), "pivots", parts)  # as a table, so that the join with it can be divided where a list is long
    stars = members.join(pivots, "h").where("key <> p.key").withColumns(_against_pivot()).where(_COMPATIBLE)
    pairs = staged(summed.where(reach).select("u", "v").union(stars.select(*_ordered("key", "p.key"))).distinct(), "pairs", parts)

    release(product)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("key")).union(members.select("key")).distinct()
    sets = _candidate_sets(source, wanted, parts)
    checked = staged(_overlaps(pairs, sets), "checked", parts)
    release(pairs)
    done = [members, pivots, sets, checked]
    links = checked.where(_LINKED).select("u", "v")

    if not members.isEmpty():
        labelled = staged(_with_labels(members, links, parts), "labelled", parts)
        second = staged(_overlaps(_star_pairs(labelled, parts), sets), "checked", parts)
        release(labelled)
        links = links.union(second.where(_LINKED).select("u", "v"))
        labelled = staged(_with_labels(members, links, parts), "labelled", parts)
        rest = _rest_pairs(labelled, pivots, checked.union(second), parts)
        third = staged(_overlaps(rest, sets).where(_LINKED).select("u", "v"), "checked", parts)
        links = links.union(third)
        done += [second, labelled, third]
    found = _labelled_documents(base, links, parts)
    release(*done)  # the components of the links are a table of their own
    return found


def _rest_pairs(labelled: DataFrame, pivots: DataFrame, checked: DataFrame, parts: int) -> DataFrame:
    """Pairs of a list's members in different components that their sizes, their distances from the pivot and earlier checks leave open."""
    mixed = labelled.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("h")
    mixed = staged(mixed.join(pivots, "h"), "mixed", parts)  # a row a list
    distance = (1 - F.col("shared") / (F.col("n_u") + F.col("n_v") - F.col("shared"))).alias("d")
    far = checked.select("u", "v", distance)
    to_pivot = labelled.join(mixed, "h").select("h", "key", "n", "rare", "place", "label", *_ordered("key", "p.key"))
    open_members = to_pivot.join(far, ["u", "v"], "left").select("h", "key", "n", "rare", "place", "label", F.when(F.col("u") == F.col("v"), 0.0).otherwise(F.col("d")).alias("d"))
    a = open_members.select("h", F.col("key").alias("u"), F.col("n").alias("n_u"), F.col("rare").alias("rare_u"), F.col("place").alias("place_u"), F.col("label").alias("l_u"), F.col("d").alias("d_u"))
    b = open_members.select("h", F.col("key").alias("v"), F.col("n").alias("n_v"), F.col("rare").alias("rare_v"), F.col("place").alias("place_v"), F.col("label").alias("l_v"), F.col("d").alias("d_v"))
    near = F.coalesce(F.abs(F.col("d_u") - F.col("d_v")) <= 0.2500001, F.lit(True))
    # sizes within 4/3 lie in the same band or in neighbouring ones
    band = F.floor(F.log(F.col("n_u")) / math.log(4 / 3)).cast("int")
    a = a.withColumn("band", band)
    b = b.withColumn("bands", F.floor(F.log(F.col("n_v")) / math.log(4 / 3)).cast("int")).withColumn("band_v", F.explode(F.array(F.col("bands") - 1, F.col("bands"), F.col("bands") + 1)))
    found = a.join(b, (a["h"] == b["h"]) & (F.col("band") == F.col("band_v")) & (F.col("u") < F.col("v")) & (F.col("l_u") != F.col("l_v")) & F.expr(_COMPATIBLE) & F.expr(_REACH) & near)
    return found.select("u", "v").distinct().join(checked.select("u", "v"), ["u", "v"], "left_anti")


def _candidate_sets(source: DataFrame, wanted: DataFrame, parts: int) -> DataFrame:
    """(key, data) of the wanted classes, each once; a Bloom filter keeps most others from being moved at all."""
    shipped = source.sparkSession.sparkContext.broadcast(key_filter(wanted))

    rows = source.mapInArrow(_set_rows(shipped), "key long, data binary").join(wanted, "key", "left_semi")
    return staged(rows.groupBy("key").agg(F.first("data").alias("data")), "sets", parts)


def _labelled_documents(base: DataFrame, links: DataFrame, parts: int) -> DataFrame:
    classes = base.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    label = components(links, parts)
    grouped = classes.join(label, classes["key"] == label["node"], "left").select("key", "least", F.coalesce("component", "key").alias("label"))
    least = staged(grouped.groupBy("label").agg(F.min("least").alias("component_id")), "least", parts)  # so that the join with it can be divided
    named = grouped.join(least, "label").select("key", "component_id")
    return base.join(named, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
