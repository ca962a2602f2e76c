"""Sorted hash arrays: tables of 64-bit keys in shards that workers map.

A shard is one file of sorted keys and value columns.  Tasks write shards into
the shared checkpoint folder under names of their own and report them in rows
that Spark commits, so files of failed attempts are never read.  Readers map a
shard where the folder is a mounted file system; from any other store they
copy it once per worker into an unlinked local file and map that.
"""

from __future__ import annotations

import ctypes
import json
import mmap
import tempfile
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame

from .common import unique_name

_OPEN: OrderedDict = OrderedDict()
_MOST_OPEN = 16_384   # mapped files of a worker; a map holds no memory of its own
_LISTS: OrderedDict = OrderedDict()


def give_back() -> None:
    """Hand the memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` over a task's batches, with the freed memory given back at its
    end: workers outlive their tasks, and several wait beside those that work."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()
    return task


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or plain path."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_shard(folder: str, columns: dict[str, np.ndarray]) -> str:
    """Write named arrays (in order) as one file; returns its path."""
    head = json.dumps([[k, v.dtype.str, len(v)] for k, v in columns.items()]).encode()
    head += b" " * (-(len(head) + 8) % 64)
    path = f"{folder}/{unique_name('shard')}"
    store, at = store_of(path)
    store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at, compression=None) as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for v in columns.values():
            raw = np.ascontiguousarray(v).tobytes()
            out.write(raw + b"\0" * (-len(raw) % 64))
    return path


class Listing:
    """A list, one entry per shard, that a file in the shared folder holds: a
    task's closure carries the file's name, and a worker reads it once."""

    def __init__(self, path: str | None, n: int):
        self.path, self.n = path, n

    @staticmethod
    def write(folder: str, entries: list) -> Listing:
        path = f"{folder}/{unique_name('listing')}"
        store, at = store_of(path)
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(at, compression=None) as out:
            out.write(json.dumps(entries).encode())
        return Listing(path, len(entries))

    @staticmethod
    def empty(n: int) -> Listing:
        """``n`` entries of None, without a file."""
        return Listing(None, n)

    def _entries(self) -> list:
        if self.path not in _LISTS:
            store, at = store_of(self.path)
            with store.open_input_stream(at, compression=None) as src:
                _LISTS[self.path] = json.loads(src.read())
            if len(_LISTS) > 16:
                _LISTS.popitem(last=False)
        return _LISTS[self.path]

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i):
        return None if self.path is None else self._entries()[i]

    def array(self) -> np.ndarray:
        """The entries as numbers; kept beside the list."""
        key = (self.path, "array")
        if key not in _LISTS:
            _LISTS[key] = np.asarray(self._entries(), np.int64)
        return _LISTS[key]


def _map(path: str) -> mmap.mmap:
    store, at = store_of(path)
    if isinstance(store, fs.LocalFileSystem):
        with open(at, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    with tempfile.TemporaryFile() as f, store.open_input_stream(at, compression=None) as src:
        while part := src.read(1 << 22):
            f.write(part)
        f.flush()
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


def shard(path: str) -> dict[str, np.ndarray]:
    """The arrays of a shard, mapped.  Shards of one folder, that is of one
    model, stay open; those of the folder before are let go, so that a worker
    that lives through many jobs does not hold on to old models."""
    if path in _OPEN:
        _OPEN.move_to_end(path)
        return _OPEN[path]
    if _OPEN and next(reversed(_OPEN)).rsplit("/", 1)[0] != path.rsplit("/", 1)[0]:
        _OPEN.clear()
    m = _map(path)
    n = int.from_bytes(m[:8], "little")
    at, out = 8 + n, {}
    for name, kind, length in json.loads(m[8:8 + n]):
        out[name] = np.frombuffer(m, np.dtype(kind), length, at)
        size = length * np.dtype(kind).itemsize
        at += size + -size % 64
    _OPEN[path] = out
    if len(_OPEN) > _MOST_OPEN:
        _OPEN.popitem(last=False)
    return out


def shard_of(key: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a well-mixed 64-bit key: equal ranges, so shards are in key order."""
    return (((key >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes first: the empty upper bytes of small
    numbers stand together and cost nothing once the shuffle compresses them."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(raw: bytes | pa.Buffer, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    n = len(raw) // size
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(dtype) if n \
        else np.empty(0, dtype)


def delta(keys: np.ndarray) -> np.ndarray:
    """Differences of sorted keys (the first from 0)."""
    return np.diff(keys, prepend=keys.dtype.type(0))


def undelta(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=d.dtype)


def merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")  # merges sorted blocks in linear steps
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


BLOCK_DDL = "shard int, keys binary, counts binary"


def blocks(keys: np.ndarray, counts: np.ndarray, sid: np.ndarray, at_most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows of packed (key, count) blocks per shard; keys are sorted."""
    order = np.argsort(sid, kind="stable")
    keys, counts, sid = keys[order], counts[order], sid[order]
    at = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1]))) if len(sid) else []
    rows, held = [], 0
    for a, b in zip(at, np.append(at[1:], len(sid))):
        rows.append((int(sid[a]), planes(delta(keys[a:b])), planes(counts[a:b].astype(np.uint32))))
        held += b - a
        if held >= at_most:
            yield _rows(rows)
            rows, held = [], 0
    if rows:
        yield _rows(rows)


def _rows(rows: list) -> pa.RecordBatch:
    s, k, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(k, pa.binary()), pa.array(c, pa.binary())],
                                      names=["shard", "keys", "counts"])


def by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, distinct keys, summed counts) of a task's blocks, which come
    sorted by shard (see ``to_shards``): one shard is in memory at a time."""
    now, parts = None, []

    def done():
        keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        parts.clear()
        return now, *merged(keys, counts.astype(np.uint64))

    for b in batches:
        for s, k, c in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
            if s != now and parts:
                yield done()
            now = s
            parts.append((undelta(unplanes(k.as_buffer(), np.uint64)), unplanes(c.as_buffer(), np.uint32)))
    if parts:
        yield done()


def to_shards(rows: DataFrame, shards: int) -> DataFrame:
    """Rows with a ``shard`` column, all of a shard in one task and together."""
    return rows.repartition(shards, "shard").sortWithinPartitions("shard")


class Tally:
    """Counts of keys over a task, merged whenever ``most`` entries wait."""

    def __init__(self, most: int = 4_000_000):
        self.most, self.parts, self.held = most, [], 0

    def add(self, keys: np.ndarray) -> None:
        """Count every key once per occurrence."""
        k = np.sort(keys)
        if not len(k):
            return
        at = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        self.parts.append((k[at], np.diff(np.append(at, len(k))).astype(np.uint32)))
        self.held += len(at)

    def full(self) -> bool:
        return self.held >= self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        parts, self.parts, self.held = self.parts, [], 0
        if not parts:
            return np.empty(0, np.uint64), np.empty(0, np.uint32)
        return merged(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def slices(batch: pa.RecordBatch, text: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of at most ``most`` bytes of text, or one row."""
    col = batch.column(text).cast(pa.large_string())
    if len(col) == 0:
        return
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
    a = 0
    while a < len(col):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, side="right")) - 1)
        yield batch.slice(a, b - a)
        a = b
