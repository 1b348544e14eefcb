"""Files in the shared folder, from the driver and from executors: local or any store that pyarrow can open."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse


class Local:
    """A shared folder that is mounted. Files appear whole, by a rename, so a repeated task does no harm."""

    @staticmethod
    def _path(path: str) -> str:
        return urlparse(path).path if path.startswith("file:") else path

    def write(self, path: str, data: bytes) -> None:
        path = self._path(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, path)

    def read(self, path: str, start: int = 0, size: int = -1) -> bytes:
        with open(self._path(path), "rb") as f:
            f.seek(start)
            return f.read(size)

    def size(self, path: str) -> int:
        return os.path.getsize(self._path(path))


class Store:
    """A remote store, by its URI scheme."""

    def _open(self, path: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(path)

    def write(self, path: str, data: bytes) -> None:
        store, at = self._open(path)
        store.create_dir(os.path.dirname(at), recursive=True)
        part = f"{at}.{uuid.uuid4().hex}.part"
        with store.open_output_stream(part) as f:
            f.write(data)
        store.move(part, at)

    def read(self, path: str, start: int = 0, size: int = -1) -> bytes:
        store, at = self._open(path)
        with store.open_input_file(at) as f:
            f.seek(start)
            return f.read(None if size < 0 else size)

    def size(self, path: str) -> int:
        store, at = self._open(path)
        return store.get_file_info(at).size


def opener(path: str):
    return Local() if path.startswith(("file:", "/")) else Store()
