"""Files on local disks and on the file systems that pyarrow knows, by path or URI."""

from __future__ import annotations

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path on it; a path without scheme is local."""
    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:").rstrip("/") or "/"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/")


def data_files(path: str) -> list[tuple[str, int]]:
    """Files below a path with their sizes, without hidden ones; the path itself if it is one."""
    system, inner = located(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [(inner, info.size)]
    found = system.get_file_info(fs.FileSelector(inner, recursive=True))
    shown = lambda p: not any(part.startswith(("_", ".")) for part in p[len(inner) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and shown(f.path))
