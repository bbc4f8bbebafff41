"""Whole files in the shared folder, written by tasks and named only once they are complete."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


class Saved:
    """A file being written under a name of this attempt's own; a lost task leaves nothing that a manifest names."""

    def __init__(self, folder: str, ending: str) -> None:
        self.uri = f"{folder}/{uuid.uuid4().hex}{ending}"
        self.fs, self.path = opened(self.uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path, compression=None)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Returns the offset that data starts at."""
        at, self.size = self.size, self.size + len(data)
        self.out.write(data)
        return at

    def close(self) -> str:
        self.out.close()
        return self.uri


def content(uri: str) -> bytes:
    fs, path = opened(uri)
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()
