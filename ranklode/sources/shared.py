"""Rows of tables in the shared folder, read by tasks: Parquet files of any file system that
Arrow opens, one batch after the other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def batches(path: str, columns: list[str] | None = None, rows: int = 1) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows of the Parquet files below a path; none if it is missing."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, folder = fs.FileSystem.from_uri(path)
    found = where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
    for f in sorted(x.path for x in found if x.type == fs.FileType.File and x.base_name.endswith(".parquet") and not x.base_name.startswith(("_", "."))):
        with where.open_input_file(f) as stream:
            yield from pq.ParquetFile(stream).iter_batches(batch_size=rows, columns=columns)
