"""Files on whatever system an address names, for tasks that read and write parts of them."""

from __future__ import annotations

import re
from typing import Any

from pyarrow import fs

#: Hadoop's names of systems that Arrow calls otherwise.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def located(path: str) -> tuple[Any, str]:
    """The file system of a path or address (``file:``, ``s3://``, ``hdfs://`` ...), and the path on it."""
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):/", path)
    if not m:
        return fs.LocalFileSystem(), path
    if m[1] == "file":
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(_SCHEMES.get(m[1], m[1]) + path[len(m[1]) :])


def under(path: str, pattern: str = "") -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, or of the file itself, whose names the pattern finds, in order."""
    system, at = located(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True))
    scheme = path[: path.index("://") + 3] if "://" in path and not path.startswith("file:") else ""
    return sorted((scheme + x.path, x.size) for x in found if x.type == fs.FileType.File and re.search(pattern, x.base_name))
