"""Files by URI for code in tasks, where Spark has no writer of single files."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path and the path in it; a path without a scheme is a local one."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def put(path: str, data: bytes) -> None:
    """Write a whole file under another name first, so that a lost or repeated task leaves no part of one."""
    store, place = opened(path)
    folder = place.rpartition("/")[0]
    if folder:
        store.create_dir(folder, recursive=True)
    part = f"{folder}{'/' * bool(folder)}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as f:
        f.write(data)
    store.move(part, place)


def get(path: str) -> bytes:
    store, place = opened(path)
    with store.open_input_stream(place) as f:
        return f.read()


def listed(path: str, suffix: str = "") -> list[tuple[str, int]]:
    """(path, size) of the files in a folder, by name, hidden ones left out; of the file itself if it is one. Paths keep the form of ``path``."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        return []
    found = [x for x in store.get_file_info(fs.FileSelector(place)) if x.type == fs.FileType.File and x.base_name.endswith(suffix) and not x.base_name.startswith(".")]
    return sorted((f"{path.rstrip('/')}/{x.base_name}", x.size) for x in found)
