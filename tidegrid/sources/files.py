"""Files by path or URI, from driver and executors, through Arrow's file systems."""

from __future__ import annotations

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path); a path without a scheme is a local one."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def with_suffix(uri: str, suffix: str) -> str:
    """The path with another suffix, or with one if its last component has none."""
    folder, slash, name = uri.rpartition("/")
    stem, dot, _ = name.rpartition(".")
    return folder + slash + (stem if dot and stem else name) + suffix


def size(uri: str) -> int:
    system, path = locate(uri)
    info = system.get_file_info(path)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(uri)
    return info.size


def exists(uri: str) -> bool:
    system, path = locate(uri)
    return system.get_file_info(path).type != fs.FileType.NotFound


def read_range(uri: str, start: int, length: int) -> bytes:
    system, path = locate(uri)
    with system.open_input_file(path) as f:
        return f.read_at(length, start)


def read_all(uri: str) -> bytes:
    system, path = locate(uri)
    with system.open_input_file(path) as f:
        return f.read()


def write_all(uri: str, data: bytes) -> None:
    system, path = locate(uri)
    parent = path.rpartition("/")[0]
    if parent:
        system.create_dir(parent, recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)
