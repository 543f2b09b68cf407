"""Files of numpy arrays in the shared folder, which tasks write once and map into their memory."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs

#: Files of stores that are not local folders, by URL: a worker copies each but once.
_copies: dict[str, np.ndarray] = {}


def put(folder: str, name: str, arrays: dict[str, np.ndarray]) -> None:
    """One file with a header; a task that runs again replaces it whole."""
    head, at, blobs = {}, 0, []
    for key, a in arrays.items():
        raw = np.ascontiguousarray(a)
        head[key] = [at, len(raw), raw.dtype.str]
        blobs.append(raw)
        at += -(-raw.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    temp = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(temp) as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for raw in blobs:
            out.write(raw.tobytes() + bytes(-raw.nbytes % 64))
    system.move(temp, f"{path}/{name}")


def _raw(system: fs.FileSystem, path: str) -> np.ndarray:
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r")
    if path not in _copies:
        for old in [p for p in _copies if p.rpartition("/")[0] != path.rpartition("/")[0]]:
            del _copies[old]
        number, local = tempfile.mkstemp()
        os.close(number)
        fs.copy_files(path, local, source_filesystem=system, destination_filesystem=fs.LocalFileSystem())
        _copies[path] = np.memmap(local, np.uint8, "r")
        os.unlink(local)  # its space is free once it is no longer mapped
    return _copies[path]


def mapped_file(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, as a memory map; from a store that is not a local folder, by way of a local copy."""
    system, path = fs.FileSystem.from_uri(folder)
    raw = _raw(system, f"{path}/{name}")
    size = int.from_bytes(raw[:8].tobytes(), "little")
    out = {}
    for key, (at, n, kind) in json.loads(raw[8 : 8 + size].tobytes()).items():
        first = 8 + size + at
        out[key] = raw[first : first + n * np.dtype(kind).itemsize].view(kind)
    return out


def there(folder: str, name: str) -> bool:
    system, path = fs.FileSystem.from_uri(folder)
    return system.get_file_info(f"{path}/{name}").type != fs.FileType.NotFound
