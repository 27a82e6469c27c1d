"""Files of a store by uri or path: local and whatever file systems pyarrow knows."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def at(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a uri or absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def size(uri: str) -> int:
    system, path = at(uri)
    return system.get_file_info(path).size


def read(uri: str, start: int = 0, length: int | None = None) -> bytes:
    system, path = at(uri)
    with system.open_input_file(path) as f:
        f.seek(start)
        return f.read() if length is None else f.read(length)


def write(uri: str, data: bytes) -> None:
    """All of the file or none: it is written beside its place and moved there, so a task may be run again."""
    system, path = at(uri)
    system.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.part"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, path)


def join(uri: str, parts: list[str], total: int, piece: int = 1 << 23) -> None:
    """A file of parts in order, a piece at a time: beside its place, and moved there when it is whole; then the parts go. Run again after that, it does nothing."""
    system, path = at(uri)
    if any(system.get_file_info(at(p)[1]).type == fs.FileType.NotFound for p in parts):
        if system.get_file_info(path).size == total:
            return
        raise FileNotFoundError(f"parts of {uri}")
    system.create_dir(posixpath.dirname(path), recursive=True)
    part = f"{path}.part"
    with system.open_output_stream(part) as out:
        for p in parts:
            with system.open_input_file(at(p)[1]) as f:
                while data := f.read(piece):
                    out.write(data)
    if system.get_file_info(part).size != total:
        raise OSError(f"{uri}: {system.get_file_info(part).size} bytes of {total}")
    system.move(part, path)
    for p in parts:
        system.delete_file(at(p)[1])


def files(uri: str, endings: tuple[str, ...]) -> list[str]:
    """The file itself, or the files of a folder and its folders that have one of the endings, in order."""
    return [name for name, _ in sized(uri, endings)]


def sized(uri: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """files() and their bytes, from one listing."""
    system, path = at(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.File:
        return [(uri, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    prefix = uri[: len(uri) - len(path)] if uri.endswith(path) else ""
    found = system.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(endings))
