"""Receiving files: checked downloads and safe unpacking, on one machine (the driver)."""

from __future__ import annotations

import hashlib
import os
import shutil
import stat
import urllib.request
import zipfile


def fetch(url: str, path: str, sha256: str) -> str:
    """Download to ``path`` unless it is there with the right hash; published only when checked."""
    if os.path.exists(path) and file_sha256(path) == sha256:
        return path
    part = f"{path}.part"
    with urllib.request.urlopen(url) as source, open(part, "wb") as target:
        shutil.copyfileobj(source, target, 1 << 20)
    if file_sha256(part) != sha256:
        os.remove(part)
        raise ValueError(f"{url} does not have the expected SHA-256")
    os.replace(part, path)
    return path


def file_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def unpack(archive: str, folder: str) -> list[str]:
    """Unpack the members that are missing; members that leave the folder, links and repeats are refused."""
    root = os.path.realpath(folder)
    made = []
    with zipfile.ZipFile(archive) as z:
        seen = set()
        for m in z.infolist():
            target = os.path.realpath(os.path.join(root, m.filename))
            if os.path.commonpath([root, target]) != root or os.path.isabs(m.filename):
                raise ValueError(f"{m.filename!r} would be written outside the folder")
            if stat.S_ISLNK(m.external_attr >> 16):
                raise ValueError(f"{m.filename!r} is a link")
            if target in seen:
                raise ValueError(f"{m.filename!r} is there twice")
            seen.add(target)
        for m in z.infolist():
            target = os.path.join(root, m.filename)
            if m.is_dir() or (os.path.exists(target) and os.path.getsize(target) == m.file_size):
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with z.open(m) as source, open(target + ".part", "wb") as out:
                shutil.copyfileobj(source, out, 1 << 20)
            os.replace(target + ".part", target)
            made.append(target)
    return made
