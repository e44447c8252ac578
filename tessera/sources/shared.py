"""Small files in a folder that the driver and all executors share (file, hdfs, s3, gs by pyarrow.fs)."""

from __future__ import annotations

import json
import os
import uuid

from pyarrow import fs as pafs


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def put_json(path: str, value: object) -> None:
    """Readers see the old file or the whole new one: written beside it under a name of its own, then moved over it."""
    fs, at = opened(path)
    folder, name = at.rsplit("/", 1)
    fs.create_dir(folder, recursive=True)
    staged = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(staged) as out:
        out.write(json.dumps(value, sort_keys=True).encode())
    fs.move(staged, at)


def exists(path: str) -> bool:
    fs, at = opened(path)
    return fs.get_file_info(at).type == pafs.FileType.File


def get_json(path: str, default: object = None) -> object:
    if not exists(path):
        return default
    fs, at = opened(path)
    with fs.open_input_stream(at) as f:
        return json.loads(f.read())


def names(folder: str) -> list[str]:
    """Names of a folder's files in order, unfinished ones left out; none where there is no folder."""
    fs, at = opened(folder)
    return sorted(i.base_name for i in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)) if i.type == pafs.FileType.File and not i.base_name.startswith("."))


def drop(path: str) -> None:
    """Deletes a file; one that isn't there is fine."""
    if exists(path):
        fs, at = opened(path)
        fs.delete_file(at)
