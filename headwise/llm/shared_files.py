"""Files in the shared folder that tasks write once and map into memory."""

from __future__ import annotations

import mmap
import tempfile
import uuid

import numpy as np
from pyarrow import fs

_ALIGN = 64


def write_arrays(root: str, arrays: dict[str, np.ndarray]) -> tuple[str, list[tuple[str, str, int, int]]]:
    """Write arrays to a new file below `root` (a URI); its URI and the places of the arrays.
    A repeated task writes another file, and only the one it reports is ever read."""
    system, path = fs.FileSystem.from_uri(root)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.bin"
    places, at = [], 0
    with system.open_output_stream(f"{path}/{name}") as out:
        for key, array in arrays.items():
            data = np.ascontiguousarray(array)
            places.append((key, data.dtype.str, at, len(data)))
            out.write(data.tobytes())
            pad = -data.nbytes % _ALIGN
            out.write(b"\0" * pad)
            at += data.nbytes + pad
    return f"{root.rstrip('/')}/{name}", places


def map_arrays(uri: str, places) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped. From a store that cannot be mapped the file is first
    copied to a nameless temporary one, which goes with the process."""
    system, path = fs.FileSystem.from_uri(uri)
    if isinstance(system, fs.LocalFileSystem):
        with open(path, "rb") as f:
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.seek(0, 2) else b""
    else:
        with tempfile.TemporaryFile() as f, system.open_input_stream(path) as source:
            while part := source.read(1 << 22):
                f.write(part)
            f.flush()
            held = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if f.tell() else b""
    return {key: np.frombuffer(held, dtype, n, at) if n else np.empty(0, dtype) for key, dtype, at, n in places}
