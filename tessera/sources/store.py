"""Files by path or URI: local ones by the operating system, others by pyarrow's file systems."""

from __future__ import annotations

import os
import re


def plain(path: str) -> str:
    """A local path without its scheme; other URIs as they are."""
    return re.sub("^file:/+", "/", path)


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", path))


def is_remote(path: str) -> bool:
    return "://" in plain(path)


def opened(path: str):
    """A file to read from, by bytes and places."""
    if not is_remote(path):
        return open(plain(path), "rb")
    system, place = _remote(path)
    return system.open_input_file(place)


def created(path: str):
    """A file to write to; its folder is made."""
    if not is_remote(path):
        os.makedirs(os.path.dirname(plain(path)) or ".", exist_ok=True)
        return open(plain(path), "wb")
    system, place = _remote(path)
    system.create_dir(place.rpartition("/")[0], recursive=True)
    return system.open_output_stream(place)


def size(path: str) -> int:
    """Bytes of a file, 0 if there is none."""
    if not is_remote(path):
        return os.path.getsize(plain(path)) if os.path.exists(plain(path)) else 0
    system, place = _remote(path)
    return system.get_file_info(place).size or 0


def listed(folder: str) -> list[str]:
    """The files below a remote folder, in order; none whose name or folder begins with a dot. A file is listed by itself."""
    from pyarrow import fs

    system, place = _remote(folder)
    info = system.get_file_info(place)
    head = folder[: len(folder) - len(place)] if folder.endswith(place) else folder.partition("://")[0] + "://"
    if info.is_file:
        return [folder]
    found = system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    below = lambda p: p[len(place) :].split("/")
    return [head + f.path for f in sorted(found, key=lambda f: below(f.path)) if f.is_file and not any(x.startswith(".") for x in below(f.path))]


def moved(path: str, to: str) -> None:
    if not is_remote(path):
        os.rename(plain(path), plain(to))
    else:
        system, place = _remote(path)
        system.move(place, _remote(to)[1])
