"""Files opened inside tasks, whatever their scheme: Arrow's file systems, HTTP, or a Python client."""

from __future__ import annotations

import io
import urllib.error
import urllib.request
from typing import BinaryIO
from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs

from .connectors import PYTHON, open_url

#: Schemes that Arrow knows by another name.
_ARROW = {"s3a": "s3", "s3n": "s3", "gcs": "gs"}


def local_path(url: str) -> str | None:
    """The path of a local file, given plainly or as file:/x or file:///x; None for other schemes."""
    if url.startswith("file:"):
        return "/" + unquote(url[5:]).lstrip("/")
    return None if "://" in url else url


def open_stream(url: str) -> BinaryIO:
    """A stream of a file's bytes. A file that is not there is a FileNotFoundError, whatever the scheme."""
    path = local_path(url)
    if path is not None:
        return open(path, "rb")
    scheme = urlparse(url).scheme
    if scheme in ("http", "https"):
        try:
            return urllib.request.urlopen(url, timeout=60)  # noqa: S310
        except urllib.error.HTTPError as e:
            raise (FileNotFoundError(url) if e.code in (404, 410) else e) from e
    if scheme in PYTHON:
        return io.BytesIO(open_url(url))
    fs, inside = pafs.FileSystem.from_uri(_ARROW.get(scheme, scheme) + url[len(scheme) :])
    return fs.open_input_stream(inside)


def read_bytes(url: str) -> bytes:
    with open_stream(url) as f:
        return f.read()
