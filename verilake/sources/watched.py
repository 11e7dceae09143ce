"""The files that appear under a folder, as a stream whose driver holds no file.

Spark's own file source keeps each path that it has seen, and a status of every
file under the folder, on the driver. Here the driver goes through the names and
writes them to lists as it goes; tasks look at the files of a list, and which
paths are new is told by the state of the query (``live.catalog``).
"""

from __future__ import annotations

import contextlib
import fnmatch
import hashlib
import os
import re
import shutil
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from verilake.sources.listing import any_case

#: Names of a list, which is one task's.
_NAMES = 10_000
_GONE = (FileNotFoundError, NotADirectoryError)


def _hidden(name: str) -> bool:
    """What Spark's file sources pass over."""
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def names(root: str, extension: str) -> Iterator[str]:
    """Paths, from the folder on, of the files with an extension in it and below, in the folders' own order.

    What is held is a folder for each level, however many files there are. Links
    are followed, but for those back to a folder above. What goes meanwhile is passed
    over; a folder that cannot be listed is an error.
    """
    wanted = re.compile(fnmatch.translate(any_case(extension))).match
    above: list[tuple] = []
    try:
        with contextlib.suppress(*_GONE):
            above.append((os.scandir(root), "", os.path.realpath(root)))
        while above:
            found, at, canonical = above[-1]
            e = next(found, None)
            if e is None:
                above.pop()[0].close()
            elif _hidden(e.name):
                continue
            elif _is(e, os.DirEntry.is_dir):
                own = os.path.realpath(e.path) if e.is_symlink() else f"{canonical.rstrip('/')}/{e.name}"
                if not e.is_symlink() or not any(f"{c}/".startswith(f"{own.rstrip('/')}/") for _, _, c in above):
                    with contextlib.suppress(*_GONE):
                        above.append((os.scandir(e.path), f"{at}{e.name}/", own))
            elif wanted(e.name) and _is(e, os.DirEntry.is_file):
                yield at + e.name
    finally:
        for found, _, _ in above:
            found.close()


def _is(e: os.DirEntry, kind: Callable[[os.DirEntry], bool]) -> bool:
    try:
        return kind(e)
    except OSError:
        if e.is_symlink():  # it leads nowhere
            return False
        raise


@dataclass
class NameList(InputPartition):
    path: str


class FilesAppearing(DataSource):
    """path, size of every file under a folder whenever the names there are others than before.

    Options: root, extension, looks (a folder for lists), own (true: a new one inside that for each stream).
    """

    @classmethod
    def name(cls) -> str:
        return "verilake_files_appearing"

    def schema(self) -> str:
        return "path string, size long"

    def streamReader(self, schema) -> DataSourceStreamReader:
        looks = self.options["looks"]
        return Looks(self.options["root"], self.options["extension"], f"{looks}/{uuid.uuid4().hex}" if self.options["own"] == "true" else looks)


class Looks(DataSourceStreamReader):
    """An offset is the names of a look: their number and the sum of their digests. A look's lists lie in a folder of that name until its batch is over."""

    def __init__(self, root: str, extension: str, looks: str):
        self.root, self.extension, self.looks = root, extension, looks
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return self._offset(0, 0)

    def latestOffset(self) -> dict:
        if self.last is None or self._seen() != self.last:
            self.last = self._listed()
        return self.last

    def partitions(self, start: dict, end: dict) -> list[NameList]:
        if start == end:
            return []
        at = self._place(end)
        if not os.path.isdir(at):  # lists that did not outlive the stream: what is there now
            self._listed(at)
        return [NameList(f"{at}/{k}") for k in sorted(os.listdir(at))]

    def read(self, partition: NameList) -> Iterator[pa.RecordBatch]:
        paths, sizes = [], []
        with open(partition.path, "rb") as f:
            for name in f.read().split(b"\0"):
                with contextlib.suppress(*_GONE, UnicodeDecodeError):  # gone since the look, or no path that Spark can give
                    own = f"{self.root.rstrip('/')}/{name.decode()}"
                    sizes.append(os.stat(own).st_size)
                    paths.append(f"file:{own}")
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "size"])

    def commit(self, end: dict) -> None:
        """Lists of looks whose batches are over go."""
        if self.last is not None and os.path.isdir(self.looks):
            for x in os.listdir(self.looks):
                if x != os.path.basename(self._place(self.last)):
                    shutil.rmtree(f"{self.looks}/{x}", ignore_errors=True)

    def _place(self, offset: dict) -> str:
        return f"{self.looks}/{offset['files']}-{offset['names']}"

    def _offset(self, n: int, total: int) -> dict:
        return {"files": n, "names": f"{total % (1 << 128):032x}"}

    def _seen(self, put=None) -> dict:
        n = total = 0
        for name in names(self.root, self.extension):
            own = os.fsencode(name)
            n, total = n + 1, total + int.from_bytes(hashlib.blake2b(own, digest_size=16).digest())
            if put is not None:
                put(own)
        return self._offset(n, total)

    def _listed(self, at: str | None = None) -> dict:
        """Look, with the names written to lists, which are there at once or not at all."""
        own = f"{self.looks}/{uuid.uuid4().hex}"
        os.makedirs(own)
        held: list[bytes] = []
        written = 0

        def put(name: bytes | None) -> None:
            nonlocal written
            if name is not None:
                held.append(name)
            if held and (name is None or len(held) == _NAMES):
                with open(f"{own}/{written:08d}", "wb") as f:
                    f.write(b"\0".join(held))
                written += 1
                held.clear()

        offset = self._seen(put)
        put(None)
        try:
            os.rename(own, at or self._place(offset))
        except OSError:
            if not os.path.isdir(at or self._place(offset)):
                raise
            shutil.rmtree(own)  # the same names are listed already
        return offset
