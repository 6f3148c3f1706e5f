"""Binary files that tasks write into a shared folder: temporary names, then a rename; any store that Arrow opens."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI such as file:///..., hdfs://... or s3://..."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


class Committed:
    """A file that appears under its name only when it is complete; a task that is run again writes the same bytes."""

    def __init__(self, folder: str, name: str) -> None:
        self.fs, root = place(folder)
        self.fs.create_dir(root, recursive=True)
        self.name, self.to = name, f"{root}/{name}"
        self.temp = f"{root}/_temporary-{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def commit(self) -> int:
        self.out.close()
        self.fs.move(self.temp, self.to)
        return self.size

    def abort(self) -> None:
        self.out.close()
        self.fs.delete_file(self.temp)
