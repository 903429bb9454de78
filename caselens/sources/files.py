"""Listing and opening files inside tasks."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs

ALIASES = {"s3a": "s3", "s3n": "s3"}  # schemes that Spark and Arrow spell differently


PACKED = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}


def open_file(path: str, unpacked: bool = False) -> pa.NativeFile:
    """A file by the path Spark lists it with; ``unpacked`` reads through a compression its name tells."""
    file = _open(path)
    codec = PACKED.get(path.rsplit(".", 1)[-1].lower()) if unpacked else None
    return pa.CompressedInputStream(file, codec) if codec else file


def _open(path: str) -> pa.NativeFile:
    store, inner = _store(path)
    return pa.OSFile(inner) if store is None else store.open_input_file(inner)


def _store(path: str) -> tuple[fs.FileSystem | None, str]:
    """The file system, None for the machine's own, and the path in it."""
    scheme, rest = re.match(r"(?:([a-z][a-z0-9+.-]*):)?(.*)", path, re.DOTALL).groups()
    if scheme in (None, "file"):
        return None, "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}:{rest}")


def reachable(path: str) -> bool:
    """Whether tasks can list and open it by themselves; some stores only Spark's readers know."""
    try:
        store, inner = _store(path)
        return store is None or store.get_file_info(inner).type != fs.FileType.NotFound
    except (OSError, ValueError, NotImplementedError):
        return False


def entries(folder: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, whether it is a folder, bytes, time of change in microseconds) of what is in a folder."""
    store, inner = _store(folder)
    if store is not None:
        for info in store.get_file_info(fs.FileSelector(inner)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0, (info.mtime_ns or 0) // 1000
        return
    with os.scandir(inner) as found:
        for entry in found:
            try:
                status = entry.stat()
            except FileNotFoundError:  # a link to nothing, or gone meanwhile
                continue
            yield entry.name, stat.S_ISDIR(status.st_mode), status.st_size, status.st_mtime_ns // 1000
