"""Files of any store that Arrow reaches, by the paths that Spark gives."""

from __future__ import annotations

from urllib.parse import unquote

import pyarrow.fs as pafs


def locate(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path in it."""
    if "://" in uri and not uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + unquote(uri.removeprefix("file:")).lstrip("/")
    return pafs.LocalFileSystem(), uri
