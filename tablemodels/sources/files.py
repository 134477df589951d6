"""Files that tasks open themselves, by the names Spark gives them."""

from __future__ import annotations

import posixpath
import re
import uuid
from urllib.parse import unquote

from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path) of a URI or an absolute path; Spark's ``file:/x`` and ``s3a://`` are understood."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), unquote(re.sub("^file:/*", "/", uri))
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def open_file(uri: str):
    """A file to read by ranges."""
    system, path = file_system(uri)
    return system.open_input_file(path)


def write_file(folder: str, name: str, data: bytes) -> None:
    """One whole file; it appears under its name only when complete, so a repeated task replaces it."""
    system, path = file_system(folder)
    system.create_dir(path, recursive=True)
    hidden = posixpath.join(path, f".{name}.{uuid.uuid4().hex}")
    with system.open_output_stream(hidden) as out:
        out.write(data)
    system.move(hidden, posixpath.join(path, name))
