"""Reading and writing single files by URI from tasks, on any file system that Arrow knows."""

from __future__ import annotations

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else uri.replace("file:", "file://", 1))


def write(uri: str, data: bytes) -> None:
    """Write a whole file; a reader sees all of it or, under its final name, nothing."""
    system, path = locate(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path + ".part") as f:
        f.write(data)
    system.move(path + ".part", path)


def read(uri: str, start: int = 0, length: int | None = None) -> bytes:
    """``length`` bytes from ``start`` (to the end if None)."""
    system, path = locate(uri)
    with system.open_input_file(path) as f:
        return bytes(f.read_at((f.size() - start) if length is None else length, start))


def tail(uri: str, length: int) -> bytes:
    system, path = locate(uri)
    with system.open_input_file(path) as f:
        n = min(length, f.size())
        return bytes(f.read_at(n, f.size() - n))
