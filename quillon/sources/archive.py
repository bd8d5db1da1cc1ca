"""Unpacking archives without leaving the target folder."""

from __future__ import annotations

import shutil
import zipfile
from pathlib import Path, PurePosixPath


def unpack(archive: str, target: str) -> int:
    """Files written. An absolute name, ``..`` or a link out of ``target`` raises before anything is unpacked."""
    folder = Path(target).resolve()
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            name = PurePosixPath(info.filename)
            if name.is_absolute() or ".." in name.parts or not (folder / name).resolve().is_relative_to(folder):
                raise ValueError(f"unsafe name in archive: {info.filename}")
        files = [i for i in z.infolist() if not i.is_dir()]
        for info in files:
            place = folder / info.filename
            place.parent.mkdir(parents=True, exist_ok=True)
            with z.open(info) as source, place.open("wb") as sink:
                shutil.copyfileobj(source, sink, 1 << 20)
    return len(files)
