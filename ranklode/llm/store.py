"""Files below a URI for Python data sources: local paths with Python's own files, other
schemes through Arrow's file systems. Written files count only once the manifest of their
job names them."""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlsplit

MANIFEST = "_manifest.json"


class _Local:
    """A shared folder that is mounted."""

    def __init__(self, path: str):
        self.path = os.path.normpath(path)

    def join(self, name: str) -> str:
        return os.path.join(self.path, name) if name else self.path

    def create(self, name: str):
        os.makedirs(self.path, exist_ok=True)
        return open(self.join(name), "wb")

    def open(self, name: str):
        return open(self.join(name), "rb")

    def move(self, old: str, new: str) -> None:
        os.replace(self.join(old), self.join(new))

    def delete(self, name: str) -> None:
        os.remove(self.join(name))

    def files(self) -> dict[str, int]:
        if os.path.isfile(self.path):
            return {"": os.path.getsize(self.path)}
        found = [os.path.join(d, x) for d, _, names in os.walk(self.path) for x in names]
        return {os.path.relpath(x, self.path): os.path.getsize(x) for x in sorted(found)}


class _Remote:
    def __init__(self, uri: str):
        from pyarrow import fs

        self.fs, (self.where, self.path) = fs, fs.FileSystem.from_uri(uri)

    def join(self, name: str) -> str:
        return f"{self.path}/{name}" if name else self.path

    def create(self, name: str):
        self.where.create_dir(self.path, recursive=True)
        return self.where.open_output_stream(self.join(name))

    def open(self, name: str):
        return self.where.open_input_file(self.join(name))

    def move(self, old: str, new: str) -> None:
        self.where.move(self.join(old), self.join(new))

    def delete(self, name: str) -> None:
        self.where.delete_file(self.join(name))

    def files(self) -> dict[str, int]:
        info = self.where.get_file_info(self.path)
        if info.type == self.fs.FileType.File:
            return {"": info.size}
        found = self.where.get_file_info(self.fs.FileSelector(self.path, recursive=True, allow_not_found=True))
        return {x.path[len(self.path) :].lstrip("/"): x.size for x in sorted(found, key=lambda x: x.path) if x.type == self.fs.FileType.File}


def place(uri: str):
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return _Local(unquote(parts.path) if parts.scheme else uri)
    return _Remote(uri)


def create(uri: str, suffix: str):
    """A new file's name and stream; names never clash, so a task that runs twice is harmless."""
    name = f"part-{uuid.uuid4().hex}{suffix}"
    return name, place(uri).create(name)


def commit(uri: str, files: list[dict]) -> None:
    """Add files to the manifest; what isn't named there is left by lost attempts."""
    where = place(uri)
    files = [*(manifest(uri) or []), *sorted(files, key=lambda x: x["name"])]
    with where.create(f"{MANIFEST}.new") as f:
        f.write(json.dumps(files).encode())
    where.move(f"{MANIFEST}.new", MANIFEST)


def remove(uri: str, names: list[str]) -> None:
    where = place(uri)
    for name in names:
        where.delete(name)


def manifest(uri: str) -> list[dict] | None:
    where = place(uri)
    if MANIFEST not in where.files():
        return None
    with where.open(MANIFEST) as f:
        return json.loads(f.read())


def listing(uri: str, suffixes: tuple[str, ...]) -> list[dict]:
    """The manifest's files, or those found: foreign files need no manifest."""
    got = manifest(uri)
    if got is not None:
        return got
    return [{"name": k, "size": v} for k, v in place(uri).files().items() if not k or k.endswith(suffixes)]


def open_file(uri: str, name: str):
    return place(uri).open(name)
