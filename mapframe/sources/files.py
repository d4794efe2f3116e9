"""Files through pyarrow file systems, for data sources that run inside tasks."""

from __future__ import annotations

from pyarrow import fs


def locate(path: str):
    """(file system, path inside it) of a local path or URI."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def read_range(path: str, start: int, size: int | None) -> bytes:
    system, inner = locate(path)
    with system.open_input_file(inner) as f:
        return f.read_at(f.size() - start if size is None else min(size, max(0, f.size() - start)), start)


def exists(path: str) -> bool:
    system, inner = locate(path)
    return system.get_file_info(inner).type == fs.FileType.File


def matching(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The file itself, or the files of a directory with one of the suffixes, sorted."""
    system, inner = locate(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(inner, recursive=True))
        names = sorted(i.path for i in found if i.is_file and i.path.lower().endswith(suffixes)
                       and not any(p.startswith(("_", ".")) for p in i.path[len(inner):].split("/") if p))
    else:
        names = [inner]
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    return [prefix + n for n in names]
