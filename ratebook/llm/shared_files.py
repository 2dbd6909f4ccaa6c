"""Whole files that tasks write into the folder that all executors share."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs

__all__ = ["write_file"]


def write_file(uri: str, data: bytes) -> None:
    """Puts data at uri in one step: under another name first, then moved, so that readers never see a part of it.

    The folder's store is one that Arrow's file systems reach (file, hdfs, s3, gs, abfs). Two attempts of a task write the
    same bytes, so it doesn't matter which comes last.
    """
    fs, path = pafs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, path)
