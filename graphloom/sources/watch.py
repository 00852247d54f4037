"""A stream of changes below a source tree, as a Python data source.

The built-in file stream tells neither modified nor deleted files. This one keeps snapshots of the tree as
directories by digest: a directory's digest is that of its entries - files with size and time of change,
directories with their own digests - and its entries are kept under it, once for all snapshots that hold
them. An offset is the digest of the root, whatever the number of files, and two snapshots are compared by
going down where digests differ. The listing comes through Arrow's file systems, so a tree can lie on any
store they open; directories are kept in the folder ``state``, beside the stream's checkpoint.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

from pyarrow import fs as stores
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from graphloom.sources.tree import listed, store_of

#: The digest that stands for no directory.
NONE = ""
#: Entries of one directory: of a file "f" and its mark, of a directory "d" and its digest.
Entries = dict[str, tuple[str, str]]


class Snapshots:
    """Directories by digest in a folder of any store."""

    def __init__(self, folder: str):
        self.store, self.base = store_of(folder)
        #: How many directories were read, and how many written.
        self.read = self.written = 0

    def entries(self, digest: str) -> Entries:
        if digest == NONE:
            return {}
        self.read += 1
        with self.store.open_input_stream(f"{self.base}/{digest[:2]}/{digest}") as file:
            return {k: tuple(v) for k, v in json.loads(file.read()).items()}

    def keep(self, entries: Entries) -> str:
        """The digest of a directory, whose entries are written unless they are there."""
        if not entries:
            return NONE
        text = json.dumps(entries, sort_keys=True).encode()
        digest = hashlib.sha256(text).hexdigest()
        path = f"{self.base}/{digest[:2]}/{digest}"
        if self.store.get_file_info([path])[0].type == stores.FileType.NotFound:
            self.store.create_dir(path.rpartition("/")[0], recursive=True)
            with self.store.open_output_stream(path) as file:
                file.write(text)
            self.written += 1
        return digest

    def take(self, files: list[tuple[str, int, int]]) -> str:
        """The digest of a tree of files (path, bytes, time)."""
        inside: dict[str, Entries] = {"": {}}
        for path, size, at in files:
            folder, _, name = path.rpartition("/")
            inside.setdefault(folder, {})[name] = ("f", f"{size}:{at}")
            while folder and folder.rpartition("/")[0] not in inside:
                folder = folder.rpartition("/")[0]
                inside[folder] = {}
        for folder in sorted(inside, key=lambda x: -x.count("/") - bool(x)):  # the deepest first
            if folder:
                above, _, name = folder.rpartition("/")
                inside[above][name + "/"] = ("d", self.keep(inside[folder]))
        return self.keep(inside[""])

    def changes(self, before: str, after: str, lead: str = "") -> Iterator[tuple[str, str, int]]:
        """(path, change, time) between two trees; equal directories are not read. A deletion is timed just after the file's last change."""
        if before == after:
            return
        old, new = self.entries(before), self.entries(after)
        for name in sorted(old.keys() | new.keys()):
            was, now = old.get(name), new.get(name)
            if was == now:
                continue
            if (was or now)[0] == "d":
                yield from self.changes(was[1] if was else NONE, now[1] if now else NONE, lead + name)
            else:
                change = "deleted" if now is None else "added" if was is None else "modified"
                yield lead + name, change, int((now or was)[1].partition(":")[2]) + (now is None)


class TreeWatch(DataSource):
    """``spark.readStream.format("treewatch").option("state", folder).load(root)``: path, change, at (nanoseconds)."""

    @classmethod
    def name(cls) -> str:
        return "treewatch"

    def schema(self) -> str:
        return "path string, change string, at long"

    def simpleStreamReader(self, schema):  # noqa: N802 - the name is Spark's
        return _Reader(self.options["path"], self.options["state"])


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str, state: str):
        self.root, self.snapshots = root, Snapshots(state)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tree": NONE}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        now = self.snapshots.take(listed(self.root))
        return iter(list(self.snapshots.changes(start["tree"], now))), {"tree": now}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(list(self.snapshots.changes(start["tree"], end["tree"])))
