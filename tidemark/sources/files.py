"""Files wherever they lie, for code inside tasks."""

from __future__ import annotations

import re
import urllib.parse

from pyarrow import fs


def locate(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark writes it (not percent-encoded), and the path inside it."""
    local = re.sub(r"^file:/+", "/", path)
    if not re.match(r"\w+:/", local):
        return fs.LocalFileSystem(), local
    scheme, rest = re.sub(r"^s3[an]:", "s3:", local).split(":", 1)
    return fs.FileSystem.from_uri(f"{scheme}:{urllib.parse.quote(rest)}")
