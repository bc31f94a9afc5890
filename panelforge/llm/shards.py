"""Arrays that executors write to the shared folder once and map into memory later."""

from __future__ import annotations

import io
import os
import uuid

import numpy as np


def local_path(uri: str) -> str | None:
    """The path of a folder that this machine has mounted; None for a store with a scheme of its own."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return uri if "://" not in uri else None


def put(uri: str, array: np.ndarray) -> None:
    """Write under a name of this attempt, then rename: a task that runs twice leaves one whole file."""
    attempt = f"{uri}.{uuid.uuid4().hex}"
    if (path := local_path(attempt)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            np.save(f, array, allow_pickle=False)
        os.replace(path, local_path(uri))
        return
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(attempt)
    store.create_dir(os.path.dirname(at), recursive=True)
    held = io.BytesIO()
    np.save(held, array, allow_pickle=False)
    with store.open_output_stream(at) as f:
        f.write(held.getbuffer())
    store.move(at, fs.FileSystem.from_uri(uri)[1])


def get(uri: str) -> np.ndarray:
    """The array, mapped: only pages that are looked at are read.  From a store that cannot be mounted it is read whole."""
    if (path := local_path(uri)) is not None:
        return np.load(path, mmap_mode="r", allow_pickle=False)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(at) as f:
        return np.load(io.BytesIO(f.read()), allow_pickle=False)
