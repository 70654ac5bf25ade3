"""Arrays in files of a folder that all executors share, and normal vectors made from a hash."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyarrow import fs


@dataclass(frozen=True)
class Folder:
    """Files of sorted ids, a number and a vector for each. A file is written under another name and then moved, so that a
    task that runs twice leaves a whole one."""

    uri: str

    @staticmethod
    def new(shared: str, kind: str = "fit") -> Folder:
        return Folder(f"{shared.rstrip('/')}/{kind}-{uuid.uuid4().hex}")

    def _at(self, name: str) -> tuple[fs.FileSystem, str]:
        if self.uri.startswith("file:") or ":" not in self.uri.split("/")[0]:
            system, top = fs.LocalFileSystem(), "/" + self.uri.removeprefix("file:").lstrip("/")
        else:
            system, top = fs.FileSystem.from_uri(self.uri)
        return system, f"{top}/{name}" if name else top

    def write(self, name: str, ids: np.ndarray, numbers: np.ndarray | None, vectors: np.ndarray) -> None:
        """Without ``numbers`` they are 0."""
        system, path = self._at(name)
        vectors = np.ascontiguousarray(vectors, np.float64)
        vectors = vectors[:, None] if vectors.ndim == 1 else vectors
        numbers = np.zeros(len(ids)) if numbers is None else np.ascontiguousarray(numbers, np.float64)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        other = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(other) as out:
            out.write(np.array(vectors.shape, np.int64).tobytes())
            for array in (np.ascontiguousarray(ids, np.int64), numbers, vectors):
                out.write(array.data if array.size else b"")
        system.move(other, path)

    def read(self, name: str, low: int | None = None, high: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, numbers and vectors; only of ids from ``low`` to below ``high`` if given."""
        system, path = self._at(name)
        with system.open_input_file(path) as file:
            n, width = np.frombuffer(file.read_at(16, 0), np.int64).tolist()
            ids = np.frombuffer(file.read_at(8 * n, 16), np.int64)
            a, b = (0, n) if low is None else np.searchsorted(ids, [low, high]).tolist()
            numbers = np.frombuffer(file.read_at(8 * (b - a), 16 + 8 * n + 8 * a), np.float64)
            vectors = np.frombuffer(file.read_at(8 * width * (b - a), 16 + 16 * n + 8 * width * a), np.float64)
        return ids[a:b], numbers, vectors.reshape(b - a, width)

    def names(self) -> list[str]:
        """The files, but for those still being written."""
        system, path = self._at("")
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return sorted(x.base_name for x in found if "." not in x.base_name)

    def delete(self, *names: str) -> None:
        """Deletes folders within this one, or itself for an empty name; one that is not there is passed over."""
        for name in names:
            system, path = self._at(name)
            if system.get_file_info(path).type == fs.FileType.Directory:
                system.delete_dir(path)


P1, P2, P3, P4, P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * P2
    x = (x ^ (x >> np.uint64(29))) * P3
    return x ^ (x >> np.uint64(32))


def _with_int(seed: np.ndarray, value: np.ndarray | int) -> np.ndarray:
    """Spark's xxhash64 of an int, after what ``seed`` is the hash of."""
    low = np.asarray(value, np.int64).astype(np.uint64) & np.uint64(0xFFFFFFFF)
    return _mixed(_rotated((seed + P5 + np.uint64(4)) ^ (low * P1), 23) * P2 + P3)


def _with_text(seed: np.ndarray, text: str) -> np.ndarray:
    """The same of a text of less than four bytes."""
    found = seed + P5 + np.uint64(len(text))
    for byte in text.encode():
        found = _rotated(found ^ (np.uint64(byte) * P5), 11) * P1
    return _mixed(found)


def normals(seed: int, part: str, ids: np.ndarray, width: int) -> np.ndarray:
    """A normal vector for each id, from xxhash64(seed, part, id, place from 1, 1 or 2) as in Spark (Box-Muller)."""
    with np.errstate(over="ignore"):
        start = _with_text(_with_int(np.array([42], np.uint64), seed), part)
        of_place = _with_int(_with_int(start, ids)[:, None], np.arange(1, width + 1)[None])
        one, two = (((_with_int(of_place, k) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53) for k in (1, 2))
    return np.sqrt(-2 * np.log(one)) * np.cos(2 * np.pi * two)
