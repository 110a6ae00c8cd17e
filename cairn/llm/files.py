"""Arrays in the shared folder: written once by a task, memory-mapped by every worker.

A path may be local (file:// or bare) or of any file system that pyarrow opens.  Writers put a
file in place by renaming, so that a repeated task leaves the same whole file.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import lru_cache

import numpy as np


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def write_bytes(uri: str, *parts: bytes | memoryview | np.ndarray) -> None:
    at = _local(uri)
    if at:
        os.makedirs(os.path.dirname(at), exist_ok=True)
        tmp = f"{at}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            for p in parts:
                f.write(memoryview(np.ascontiguousarray(p)).cast("B") if isinstance(p, np.ndarray) and p.size else b"" if isinstance(p, np.ndarray) else p)
        os.replace(tmp, at)
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(tmp) as f:
        for p in parts:
            f.write(np.ascontiguousarray(p).tobytes() if isinstance(p, np.ndarray) else p)
    system.move(tmp, path)


@lru_cache(maxsize=4096)
def mapped(uri: str, dtype: str) -> np.ndarray:
    """A read-only memory map; a remote file is fetched once for each worker.  A file that isn't there is an error."""
    at = _local(uri)
    if not at:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(uri)
        fd, at = tempfile.mkstemp()
        with system.open_input_stream(path) as src, os.fdopen(fd, "wb") as out:
            while block := src.read(8 << 20):
                out.write(block)
        array = np.memmap(at, dtype, "r") if os.path.getsize(at) else np.zeros(0, dtype)
        os.unlink(at)  # the map keeps it until the worker ends
        return array
    return np.memmap(at, dtype, "r") if os.path.getsize(at) else np.zeros(0, dtype)
