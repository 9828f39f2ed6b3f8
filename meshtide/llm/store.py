"""Named arrays in the folder that driver and executors share, written whole and read by memory map."""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow.fs as pafs
from pyspark import SparkFiles

#: Arrays that a worker process keeps mapped; mapped pages are the system's to give and take.
MAPPED = 512
_mapped: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()


class Store:
    """Arrays by name. A write is a rename, so a task that runs again leaves the same file."""

    def __init__(self, uri: str):
        self.uri = uri

    def _fs(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.uri) if "://" in self.uri or self.uri.startswith("file:") else (pafs.LocalFileSystem(), self.uri)

    def write(self, name: str, array: np.ndarray) -> None:
        fs, root = self._fs()
        fs.create_dir(root, recursive=True)
        part = f"{root}/.{name}.{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as out:
            out.write(np.ascontiguousarray(array).data.cast("B") if array.size else b"")
        fs.move(part, f"{root}/{name}")

    def open(self, name: str, kind: type) -> np.ndarray:
        """The array under a name; empty if there is none.

        From a remote store it is copied once for each executor, under a name that all its tasks
        share, into the folder of Spark's files, which ends with the application.
        """
        key = (self.uri, name)
        if key in _mapped:
            _mapped.move_to_end(key)
            return _mapped[key]
        fs, root = self._fs()
        path = f"{root}/{name}"
        info = fs.get_file_info(path)
        if info.type == pafs.FileType.NotFound or not info.size:
            made = np.zeros(0, kind)
        else:
            if not isinstance(fs, pafs.LocalFileSystem):
                local = f"{SparkFiles.getRootDirectory()}/{self.uri.rpartition('/')[2]}-{name}"
                if not os.path.exists(local):
                    part = f"{local}.{uuid.uuid4().hex}"
                    pafs.copy_files(path, part, source_filesystem=fs, destination_filesystem=pafs.LocalFileSystem())
                    os.replace(part, local)
                path = local
            made = np.memmap(path, kind, "r")
        _mapped[key] = made
        while len(_mapped) > MAPPED:
            _mapped.popitem(last=False)
        return made
