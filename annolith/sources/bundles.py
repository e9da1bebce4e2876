"""Bundles: files of a run in one archive, for hand-over; made on the driver, of small files only."""

from __future__ import annotations

import zipfile
from pathlib import Path

#: Bytes that a bundle may hold unpacked.
LARGEST = 1 << 30


def bundle(root: str, patterns: list[str], target: str) -> list[str]:
    """A zip of root's files that match a pattern, in order of their names, with one time stamp for all so that equal files make equal bundles; returns the names."""
    base = Path(root)
    found = sorted({p for pattern in patterns for p in base.rglob(pattern) if p.is_file()})
    size = sum(p.stat().st_size for p in found)
    if size > LARGEST:
        raise ValueError(f"{len(found)} files of {size} bytes are too much for one bundle")
    with zipfile.ZipFile(target, "x", zipfile.ZIP_DEFLATED) as out:
        for p in found:
            out.writestr(zipfile.ZipInfo(p.relative_to(base).as_posix(), (1980, 1, 1, 0, 0, 0)), p.read_bytes(), zipfile.ZIP_DEFLATED)
    return [p.relative_to(base).as_posix() for p in found]
