"""Byte access to files of a local folder or an object store, for data sources whose tasks read and write by themselves."""

from __future__ import annotations

import posixpath
import uuid

import pyarrow.fs as pafs


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a plain path or a URI that Arrow knows (file, hdfs, s3, gs)."""
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{posixpath.abspath(path)}")


def listed(path: str, endings: tuple[str, ...]) -> list[str]:
    """Files under a path with one of the endings, by name; those of hidden and temporary folders are left out."""
    fs, base = located(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.File:
        return [path]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [f.path for f in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if f.type == pafs.FileType.File and f.path.endswith(endings)]
    shown = [f for f in found if not any(part[:1] in "._" for part in posixpath.relpath(f, base).split("/"))]
    return [posixpath.join(path, posixpath.relpath(f, base)) for f in sorted(shown)]


class Parts:
    """Part files of one write: tasks put theirs into a temporary folder, and the commit moves those of successful tasks.

    Files of a task that was lost or tried again stay behind and go with the
    temporary folder.
    """

    def __init__(self, path: str, ending: str, overwrite: bool):
        self.path, self.ending, self.overwrite, self.run = path, ending, overwrite, uuid.uuid4().hex

    @property
    def temporary(self) -> str:
        return f"{located(self.path)[1]}/_temporary-{self.run}"

    def put(self, content: bytes, partition: int, stem: str | None = None) -> str:
        """Write one part, with a name of its own or a given one; what is returned goes to commit()."""
        fs, _ = located(self.path)
        name = f"{uuid.uuid4().hex[:12]}/{stem}{self.ending}" if stem is not None else f"part-{partition:05d}-{uuid.uuid4().hex[:12]}{self.ending}"
        fs.create_dir(posixpath.dirname(f"{self.temporary}/{name}"), recursive=True)
        with fs.open_output_stream(f"{self.temporary}/{name}", compression=None) as out:
            out.write(content)
        return name

    def commit(self, names: list[str]) -> None:
        fs, base = located(self.path)
        fs.create_dir(base, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(base)):
                if f.type == pafs.FileType.File:
                    fs.delete_file(f.path)
        for name in names:
            fs.move(f"{self.temporary}/{name}", f"{base}/{posixpath.basename(name)}")
        self.abort()

    def abort(self) -> None:
        fs, _ = located(self.path)
        if fs.get_file_info(self.temporary).type == pafs.FileType.Directory:
            fs.delete_dir(self.temporary)
