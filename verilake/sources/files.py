"""Files opened inside tasks, by path or URI: local ones, and those of stores that Arrow has a file system for."""

from __future__ import annotations

import errno
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow.fs as pafs

_URI = re.compile(r"([a-zA-Z][a-zA-Z0-9+.-]*):(?://([^/]*))?(/.*)?$")


def local_path(path: str) -> str | None:
    """The plain path of a local file; None for one in a store."""
    found = _URI.match(path)
    if not found:
        return os.path.abspath(path)
    return (found[3] or "/") if found[1].lower() == "file" else None


class Stores:
    """The file systems of a task, one for each store."""

    def __init__(self):
        self.known: dict[str, tuple[pafs.FileSystem, str]] = {}

    def of(self, path: str) -> tuple[pafs.FileSystem, str]:
        if (local := local_path(path)) is not None:
            return self.known.setdefault("", (pafs.LocalFileSystem(), ""))[0], local
        scheme, authority, rest = _URI.match(path).groups()
        root = f"{scheme}://{authority or ''}/"
        if root not in self.known:
            self.known[root] = pafs.FileSystem.from_uri(root)
        store, base = self.known[root]
        return store, base.rstrip("/") + (rest or "/")

    def open(self, path: str):
        store, at = self.of(path)
        return store.open_input_file(at)


@dataclass(frozen=True)
class Entry:
    """What stands in a folder: kind is file, folder or error; canonical is the path without links."""

    kind: str
    path: str
    canonical: str
    name: str
    size: int | None = None
    modified: datetime | None = None
    error: str | None = None


def _code(e: OSError) -> str:
    return errno.errorcode.get(e.errno or 0, type(e).__name__)


def _local_entry(path: str, canonical: str, linked: bool) -> Entry:
    name = os.path.basename(path.rstrip("/"))
    try:
        if linked:
            canonical = os.path.realpath(path, strict=True)
        found = os.stat(canonical)
    except OSError as e:
        return Entry("error", path, canonical, name, error=_code(e))
    if os.path.isdir(canonical):
        return Entry("folder", path, canonical, name)
    return Entry("file", path, canonical, name, found.st_size, datetime.fromtimestamp(found.st_mtime, UTC)) if os.path.isfile(canonical) else Entry("other", path, canonical, name)


def entry_of(stores: Stores, path: str) -> Entry:
    """A root: a file, a folder, or an error."""
    if (local := local_path(path)) is not None:
        return _local_entry(local, local, True)
    store, at = stores.of(path)
    try:
        info = store.get_file_info(at)
    except OSError as e:
        return Entry("error", path, path, os.path.basename(path), error=_code(e))
    if info.type == pafs.FileType.NotFound:
        return Entry("error", path, path, info.base_name, error="ENOENT")
    return Entry("file" if info.is_file else "folder", path, path, info.base_name, info.size, info.mtime)


def entries(stores: Stores, path: str, canonical: str) -> Iterator[Entry]:
    """What stands in a folder; an entry that cannot be looked at is one error, as is a folder that cannot be listed.

    A link to a folder that the folder itself is in is an error (ELOOP). Entries come
    as the folder gives them; it is not held whole, however many there are.
    """
    if local_path(path) is None:
        yield from _stored_entries(stores, path)
        return
    found = None
    while True:
        try:
            if found is None:
                found = os.scandir(canonical)
            e = next(found, None)
        except OSError as error:
            yield Entry("error", path, canonical, os.path.basename(path), error=_code(error))
            return
        if e is None:
            return
        own = _local_entry(f"{path.rstrip('/')}/{e.name}", f"{canonical.rstrip('/')}/{e.name}", e.is_symlink())
        if own.kind == "folder" and f"{canonical}/".startswith(f"{own.canonical.rstrip('/')}/"):
            own = Entry("error", own.path, own.canonical, own.name, error="ELOOP")
        yield own


def _stored_entries(stores: Stores, path: str) -> Iterator[Entry]:
    store, at = stores.of(path)
    try:
        found = store.get_file_info(pafs.FileSelector(at))
    except OSError as e:
        yield Entry("error", path, path, os.path.basename(path), error=_code(e))
        return
    for info in sorted(found, key=lambda x: x.base_name):
        own = f"{path.rstrip('/')}/{info.base_name}"
        yield Entry("file" if info.is_file else "folder", own, own, info.base_name, info.size, info.mtime)


class Ranges:
    """Reads ranges of a file, and counts what it reads."""

    def __init__(self, opened: Callable):
        self.file = opened()
        self.size, self.bytes_read = self.file.size(), 0

    def read(self, at: int, n: int) -> bytes:
        """Up to n bytes from a position on; fewer at the end."""
        if at >= self.size or n <= 0:
            return b""
        self.file.seek(at)
        found = self.file.read(min(n, self.size - at))
        self.bytes_read += len(found)
        return found

    def close(self) -> None:
        self.file.close()


class Memory:
    """The same over bytes that are there already."""

    def __init__(self, content):
        self.view = memoryview(content)
        self.size, self.bytes_read = len(self.view), 0

    def read(self, at: int, n: int) -> bytes:
        found = bytes(self.view[at : at + n]) if n > 0 else b""
        self.bytes_read += len(found)
        return found

    def close(self) -> None:
        pass
