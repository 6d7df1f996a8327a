"""Files from elsewhere, locked to a known hash."""

from __future__ import annotations

import hashlib
import os
import tempfile
import urllib.request
from pathlib import Path

#: Bytes read at once.
STEP = 1 << 20


def fetch_locked(url: str, path: str, sha256: str, most: int = 1 << 31) -> Path:
    """The file at ``url`` (http, https or file) under ``path``, if its SHA-256 is the one given; otherwise an error and no file.

    A file that is there already with that hash is kept.  It is written beside the
    path and moved there when it is whole.
    """
    target = Path(path)
    if target.is_file() and _digest(target) == sha256:
        return target
    if not url.startswith(("http://", "https://", "file://")):
        raise ValueError(f"no address to read from: {url}")
    target.parent.mkdir(parents=True, exist_ok=True)
    fd, name = tempfile.mkstemp(dir=target.parent, prefix=".part-")
    try:
        digest, size = hashlib.sha256(), 0
        with os.fdopen(fd, "wb") as out, urllib.request.urlopen(url, timeout=60) as got:  # noqa: S310
            while block := got.read(STEP):
                size += len(block)
                if size > most:
                    raise ValueError(f"more than {most} bytes")
                digest.update(block)
                out.write(block)
        if digest.hexdigest() != sha256:
            raise ValueError(f"{url} has another hash than {sha256}")
        os.replace(name, target)
    finally:
        if os.path.exists(name):
            os.unlink(name)
    return target


def _digest(path: Path) -> str:
    digest = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(STEP):
            digest.update(block)
    return digest.hexdigest()
