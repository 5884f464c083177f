"""What the operators share: the shared folder, memory-mapped models, byte-level text vectors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import wraps
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
#: Text characters that a worker turns into vectors at a time; it bounds memory, not what is read.
CHUNK = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, that all executors share; one of our own only where it is unset, as in tests.
    It is given with its file system: a path without a scheme belongs to the default one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or ""
    jsc = spark.sparkContext._jsc.sc()
    if not folder:
        now = jsc.getCheckpointDir()
        folder = now.get() if now.isDefined() else "file://" + tempfile.mkdtemp(prefix="quarrymill-")
    if not jsc.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def remove(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_loaded: dict[str, dict[str, np.ndarray]] = {}


class Model:
    """Arrays fitted on the driver and read by every worker.

    In a shared folder of the file system they are .npy files that workers memory-map, so all workers of
    a machine share the pages; in any other kind of shared folder they travel as one broadcast. Models
    have a size fixed by parameters, not by the input. Plans that use them run later, so the files stay until the
    driver ends.
    """

    def __init__(self, spark: SparkSession, name: str, arrays: dict[str, np.ndarray]):
        self.key = f"{name}-{uuid.uuid4().hex}"
        self.names, self.folder, self.sent = sorted(arrays), None, None
        url = urlparse(shared_dir(spark))
        if url.scheme in ("", "file"):
            self.folder = os.path.join(unquote(url.path), "models", self.key)
            os.makedirs(self.folder)
            for k, v in arrays.items():
                np.save(os.path.join(self.folder, f"{k}.npy"), v)
            atexit.register(shutil.rmtree, self.folder, ignore_errors=True)
        else:
            self.sent = spark.sparkContext.broadcast(arrays)

    def __getitem__(self, name: str) -> np.ndarray:
        if self.key not in _loaded:
            if len(_loaded) > 8:  # workers are used again by later queries
                _loaded.clear()
            forget_others(self.key)
            _loaded[self.key] = self.sent.value if self.folder is None else {
                k: np.load(os.path.join(self.folder, f"{k}.npy"), mmap_mode="r") for k in self.names
            }
        return _loaded[self.key][name]


def _ascii(key: str | bytes) -> bool:
    return isinstance(key, bytes) or key.isascii()


class Memo(dict):
    """What a worker remembers of one kind: results by text, up to `room` bytes in all. When it is full it keeps what came
    first, which is mostly what is frequent. Only speed depends on it."""

    LONG = 1000

    def __init__(self, room: int):
        super().__init__()
        self.room, self.held = room, 0

    def learn(self, wanted: set, make, size=len) -> list:
        """Holds the results of all of `wanted`: make(list) gives those of what is new. The keys that are returned are
        beyond the room and go again by forget(); so do keys of more than LONG characters or bytes. A key takes its length, four bytes a
        character if any of them isn't ASCII, a value size(value), both with their share of the table."""
        new = list(wanted.difference(self))
        if not new:
            return new
        made = list(make(new))
        self.update(zip(new, made))
        long = []
        if max(map(len, new)) > self.LONG:
            long = [k for k in new if len(k) > self.LONG]
            short = [(k, v) for k, v in zip(new, made) if len(k) <= self.LONG]
            new, made = [k for k, _ in short], [v for _, v in short]
        wide = 1 if all(map(_ascii, new)) else 4
        need = 240 * len(new) + wide * sum(map(len, new)) + sum(map(size, made))
        fit = len(new) if self.held + need <= self.room else len(new) * (self.room - self.held) // need
        self.held += need * fit // max(1, len(new))
        return new[fit:] + long

    def keep(self, made: dict, size=len) -> None:
        """Holds these new results as far as there is room."""
        for k in self.learn(set(made), lambda new: map(made.__getitem__, new), size):
            del self[k]

    def forget(self, late: list) -> None:
        for k in late:
            del self[k]


def tidy() -> None:
    """Gives memory that is free back to the system, as workers are kept for other tasks beside a large JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def tidied(run):
    """run(batches, …), with tidy() at the end of a task."""

    @wraps(run)
    def whole(batches, **more):
        try:
            yield from run(batches, **more)
        finally:
            tidy()

    return whole


_memos: dict[str, object] = {}
_memo_key = ""


def memo(key: str, kind: str, room: int) -> Memo:
    """The memo of one model. A worker has those of one model at a time: another key drops all that was remembered, so
    that what a worker holds doesn't grow with the queries that it has served."""
    forget_others(key)
    if kind not in _memos:
        _memos[kind] = Memo(room)
    return _memos[kind]


def kept(key: str, kind: str, make):
    """What a worker keeps for one model, made at first; it goes as memos do."""
    forget_others(key)
    if kind not in _memos:
        _memos[kind] = make()
    return _memos[kind]


def forget_others(key: str) -> None:
    global _memo_key
    if key != _memo_key:
        _memos.clear()
        _memo_key = key
        tidy()


def place(df: DataFrame, name: str) -> int:
    """Where a column stands. Of names that differ by case alone the exact one is meant."""
    if name in df.columns:
        return df.columns.index(name)
    like = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not like:
        raise ValueError(f"no column {name}; there are {', '.join(df.columns)}")
    return like[0]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """df's columns under new names alone, whatever other columns are called."""
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return flat.select(*(F.col(f"c{place(df, c)}").alias(new) for new, c in columns.items()))


def sift(df: DataFrame, run) -> DataFrame:
    """df, all columns, whatever their names, through run(batches), which leaves out rows."""
    flat = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return flat.mapInArrow(run, flat.schema).toDF(*df.columns)


def kind(df: DataFrame, name: str) -> str:
    """A column's type as DDL."""
    return df.schema[place(df, name)].dataType.simpleString()


def free(name: str, taken: list[str]) -> str:
    """The name, with underscores behind it while it is taken (without case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def named(df: DataFrame, id_col: str, *names: str) -> DataFrame:
    """df with its first column called id_col and the others `names`; one that id_col has already gets an underscore."""
    out = [id_col]
    for n in names:
        out.append(free(n, out))
    return df.toDF(*out)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def share(key: Column, wanted: float, total: int) -> Column:
    """A predicate that holds for about `wanted` of `total` rows, decided by the hash of `key` alone."""
    if total <= wanted:
        return F.lit(True)
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int((1 << 40) * wanted / total))


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` characters, or one longer text."""
    at = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > at and size + n > limit:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


def pack(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each followed by one zero byte, and where each begins (and the end)."""
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in parts], out=offsets[1:])
    return np.frombuffer(b"\0".join([*parts, b""]), np.uint8), offsets


#: Of each byte, whether it belongs to a word: ASCII letters and digits, and every byte of other scripts.
WORDY = np.zeros(256, bool)
WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_Q = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK)
        _powers[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, x, np.uint64)]), dtype=np.uint64) for x in (_P, _Q)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes."""
    w = WORDY[buf]
    edge = np.diff(w.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span, by prefix sums of a polynomial."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
