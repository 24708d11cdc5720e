"""What the operators of this subpackage share: shared-folder staging, Arrow plumbing, word hashing."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import tessel

#: Characters of text that a Python worker holds as words at once (one longer text is held alone).
CHUNK_CHARS = 1 << 18
CHUNK_ROWS = 512


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once a session, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(tessel.__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="tessel-")) / "tessel.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _shipped.add(sc.applicationId)


#: Rows and bytes of an Arrow batch at most, so that neither side of the pipe to a worker holds many long texts at once.
BATCH_ROWS, BATCH_BYTES = 2048, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to BATCH_ROWS and BATCH_BYTES; lower ones stay."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == f"{64 << 20}b":
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]) -> object:
    """What an operator keeps in a worker from task to task, made once."""
    if name not in _kept:
        _kept[name] = make()
    return _kept[name]


def drop_kept() -> None:
    """Lets go what another operator has kept in this worker: workers outlive the queries that they work for."""
    if _kept:
        _kept.clear()
        return_memory()


def return_memory() -> None:
    """Gives memory that this worker has freed back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_package(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; one of our own only where none is set."""
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessel-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


_staged_paths: dict[tuple[str, int], list[str]] = {}  # by application and thread, in order


def _own_paths(spark: SparkSession) -> list[str]:
    return _staged_paths.setdefault((spark.sparkContext.applicationId, threading.get_ident()), [])


#: On local disks Hadoop's default file system starts a `chmod` for each file that it creates, and until that runs, its process counts
#: as large as the executor that starts it. The plain one takes the mode of a new file as it is, and writes no checksum files.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def staged(df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
    """df written as a table, of at most `parts` files, in the shared folder and read again: cuts the lineage, survives lost executors.

    Such tables stay until they are released, which what reads them must not be before it is written.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df if parts is None else df.coalesce(parts)).write.options(**_PLAIN_FILES).parquet(path)
    _own_paths(df.sparkSession).append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def _delete(spark: SparkSession, paths: list[str]) -> int:
    conf, n = spark.sparkContext._jsc.hadoopConfiguration(), 0
    for p in paths:
        for held in _staged_paths.values():
            if p not in held:
                continue
            held.remove(p)
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
            n += bool(path.getFileSystem(conf).delete(path, True))
    return n


def release(*tables: DataFrame) -> int:
    """Deletes staged tables that nothing will read any more, and returns how many."""
    return sum(_delete(t.sparkSession, [t._staged_path]) for t in tables)


def release_staged(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes all tables that this thread has staged in the application after the first `since`, but `keep`, and returns how many; their results must have been written before."""
    kept = getattr(keep, "_staged_path", None)
    return _delete(spark, [p for p in _own_paths(spark)[since:] if p != kept])


def n_staged(spark: SparkSession) -> int:
    return len(_own_paths(spark))


def fold(id_col: str, mod: int) -> Column:
    """crc32 of the id's decimal text modulo mod; a null id has no remainder and gets -1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % mod, F.lit(-1))


def hash_share(id_col: str) -> Column:
    """A number in [0, 1) that depends on the id only, for bounded training samples."""
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def groups_of(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, texts) of about CHUNK_CHARS characters each."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield at, texts[at : i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def chunks(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[int, list[str]]]:
    """groups_of the texts of a batch; null texts are empty. No more than CHUNK_ROWS texts are Python strings at once."""
    column = batch.column(text_col)
    for start in range(0, len(column), CHUNK_ROWS):
        for at, texts in groups_of([t or "" for t in column.slice(start, CHUNK_ROWS).to_pylist()]):
            yield start + at, texts


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "replace")


#: A-Z in lower case, white space (space and 9 to 13) as a space, all else as it is.
PLAIN = bytes(32 if 9 <= i <= 13 else i + 32 if 65 <= i <= 90 else i for i in range(256))
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _BASE and of its inverse modulo 2^64, n of each at least."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 19, 1 << n.bit_length())
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def packed(a: np.ndarray) -> bytes:
    """Compressed bytes of numbers, the lowest byte of all first, then the next ones, which are often equal."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()
    return np.array([len(a)], "<u4").tobytes() + pa.compress(planes, "zstd", asbytes=True)


def unpacked(blob: bytes, kind: str) -> np.ndarray:
    n, each = int(np.frombuffer(blob, "<u4", 1)[0]), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(blob[4:], n * each, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(each, n).T).view(kind).ravel()


@dataclass
class Words:
    """The words of some texts: hashes, places in the joined bytes, and words of each text."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    counts: np.ndarray
    _sums: np.ndarray

    def prefix(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Which words are longer than n bytes, and the hashes of those words' first n."""
        long = np.flatnonzero(self.ends - self.starts > n)
        at = self.starts[long]
        return long, mix((self._sums[at + n] - self._sums[at]) * _power_tables(len(self._sums))[1][at] + np.uint64(n))


def words_of(texts: list[str], table: bytes = PLAIN) -> Words:
    """Words are runs of what `table` doesn't turn into a space; their hashes are 64 bits of the translated bytes."""
    raws = [utf8(t) for t in texts]
    buffer = np.frombuffer(b" ".join([*raws, b""]).translate(table), np.uint8)
    power, inverse = _power_tables(len(buffer) + 1)
    sums = np.zeros(len(buffer) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[buffer] * power[: len(buffer)], out=sums[1:])
    inside = np.zeros(len(buffer) + 2, np.int8)
    inside[1:-1] = buffer != 32
    edge = np.diff(inside)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    bounds = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return Words(buffer, starts, ends, hashes, np.diff(np.searchsorted(starts, bounds)), sums)


def segment_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows, counts[i] of them for segment i; an empty segment sums to 0."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = counts > 0
    if full.any():
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Adam:
    """First-order optimiser with per-coordinate step sizes, over a list of arrays changed in place."""

    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads: Iterable[np.ndarray]) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-8)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, most: int, id_col: str, text_col: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """About `most` labelled rows (y, text), the same ones each time: the bounded sample that a classifier is fitted on.

    The share of labels to take is fixed by their count, so it is never one node's job to pick them. Of several
    labels of an id, the greater holds. Where one id is that of very many documents, two times `most` rows are taken.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1)).where(usable)
    share = min(1.0, most / max(1, known.count()))
    known = known.where(hash_share("_id") < share).groupBy("_id").agg(F.max("y").alias("y"))
    cols = [F.col(id_col).alias("_id"), F.col(text_col).alias("text"), *(F.col(c) for c in extra)]
    found = docs.select(*cols).join(F.broadcast(known), "_id")
    return found.orderBy(F.xxhash64("_id", "text"), "_id", "text").limit(2 * most + 64)
