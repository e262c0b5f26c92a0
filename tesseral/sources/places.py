"""Files by URI inside tasks, in any store that Arrow's file systems know."""

from __future__ import annotations

import hashlib
import re
from typing import Any
from urllib.parse import quote

BLOCK = 1 << 20


def located(uri: str) -> tuple[Any, str]:
    """(file system, path there) of a URI or a local path."""
    from pyarrow import fs

    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:/", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def as_uri(path: str) -> str:
    """The URI of a local path."""
    return "file://" + quote(path)


def there(files: Any, path: str) -> bool:
    from pyarrow import fs

    return files.get_file_info(path).type != fs.FileType.NotFound


def digest(files: Any, path: str) -> str:
    """The SHA-256 of a file, read in blocks."""
    found = hashlib.sha256()
    with files.open_input_stream(path) as f:
        while block := f.read(BLOCK):
            found.update(block)
    return found.hexdigest()
