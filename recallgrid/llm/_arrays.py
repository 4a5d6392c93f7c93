"""Sorted arrays of numbers: blocks of them in shuffles, and files of them that workers map into memory.

Each task writes its arrays as files of its own in the shared folder, under a temporary name first, so that a task that runs
again after the loss of an executor leaves the same files. From a folder that can't be mapped a file is copied first.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs

from ._common import binary_array, kept


def filesystem(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri) if "://" in uri else (pa.fs.LocalFileSystem(), uri.removeprefix("file:"))


def save(uri: str, array: np.ndarray) -> None:
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(array).data)
    fs.move(part, path)


@lru_cache(4096)
def mapped(uri: str, kind: str, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, kind)
    fs, path = filesystem(uri)
    if not isinstance(fs, pa.fs.LocalFileSystem):
        own = os.path.join(tempfile.gettempdir(), f"recallgrid-{hashlib.md5(uri.encode()).hexdigest()}-{os.path.basename(path)}")
        if not os.path.exists(own):
            pa.fs.copy_files(path, f"{own}.{os.getpid()}", source_filesystem=fs, destination_filesystem=pa.fs.LocalFileSystem())
            os.replace(f"{own}.{os.getpid()}", own)
        path = own
    return np.memmap(path, kind, "r", shape=(n,))


kept("arrays", mapped.cache_clear)


def fitted(values: np.ndarray) -> np.ndarray:
    """``values`` as the narrowest unsigned integers that hold them."""
    most = int(values.max()) if len(values) else 0
    return values.astype(next(k for k in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(k).max))


def packed(keys: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte, compressed."""
    return _planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpacked(block: bytes, n: int) -> np.ndarray:
    return np.cumsum(_of_planes(block, n, "<u8"), dtype=np.uint64)


def _planes(values: np.ndarray) -> bytes:
    """Numbers byte by byte, lowest bytes first, compressed."""
    return pa.compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def _of_planes(block: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = pa.decompress(block, size * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


BLOCK = "part int, n long, keys binary, counts binary"


def blocks(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    """Blocks of sorted ``keys`` cut by ``part`` (ascending)."""
    which, at = np.unique(part, return_index=True)
    ends = [*at[1:].tolist(), len(keys)]
    rows = [(e - a, packed(keys[a:e]), _planes(counts[a:e].astype("<u8"))) for a, e in zip(at.tolist(), ends, strict=True)] if len(keys) else []
    n, k, c = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array(n, pa.int64()), binary_array(k), binary_array(c)], ["part", "n", "keys", "counts"])


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, ascending, and where each group starts in it. Which of equal keys comes first is
    left open: the sort is not stable, and several times as fast for that."""
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.ones(len(ranked), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    return order, np.flatnonzero(fresh)


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, ascending; a place of each; for each key the number of its distinct value."""
    order, starts = grouped(key)
    back = np.empty(len(key), np.int64)
    back[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(key)))
    return key[order[starts]], order[starts], back


def by_part(part: np.ndarray) -> np.ndarray:
    """An order by part that leaves the rows of a part in the order they had."""
    return np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not keys or not sum(map(len, keys)):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order, starts = grouped(key)
    return key[order[starts]], np.add.reduceat(count[order], starts)


def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The blocks of one part summed, two at a time in a tree, so that the number of blocks costs little memory."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for n, k, c in zip(table["n"].to_pylist(), table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
        here = unpacked(k, n), _of_planes(c, n, "<i8")
        while found and len(found[-1][0]) <= 2 * len(here[0]):
            last = found.pop()
            here = summed([last[0], here[0]], [last[1], here[1]])
        found.append(here)
    return summed([k for k, _ in found], [c for _, c in found])


def pack_columns(part: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Blocks of numbers cut by ``part`` (ascending), the first column ascending within a part."""
    which, at = np.unique(part, return_index=True)
    ends = [*at[1:].tolist(), len(part)]
    cuts = list(zip(at.tolist(), ends, strict=True)) if len(part) else []
    made = [binary_array([packed(columns[0][a:e]) for a, e in cuts])]
    made += [binary_array([_planes(np.ascontiguousarray(c[a:e].astype(c.dtype.newbyteorder("<")))) for a, e in cuts]) for c in columns[1:]]
    return pa.RecordBatch.from_arrays([pa.array(which.astype(np.int32)), pa.array([e - a for a, e in cuts], pa.int64()), *made], ["part", "n", *names])


def unpack_columns(table: pa.Table, names: list[str], kinds: list[str]) -> Iterator[list[np.ndarray]]:
    """The columns of each block; the kinds are those they had, that of the first is ``<u8``."""
    for n, first, *rest in zip(table["n"].to_pylist(), *(table[c].to_pylist() for c in names), strict=True):
        yield [unpacked(first, n), *(_of_planes(b, n, k) for b, k in zip(rest, kinds[1:], strict=True))]
