"""New events from uploaded files, which file streams then pick up."""

from __future__ import annotations

import re
import shutil
from collections.abc import Iterable
from pathlib import Path, PurePosixPath
from typing import BinaryIO

from ..config import DEFAULT, Config

#: Folders that a client may send in front of its gallery, and bytes copied at a time.
FRONT = ("gallery", "images", "photos")
CHUNK = 1 << 20


def _relative(name: str) -> PurePosixPath:
    path = PurePosixPath(name.replace("\\", "/"))
    if path.is_absolute() or ".." in path.parts:
        raise ValueError(f"not a path below the event: {name!r}")
    return path


def _write(to: Path, data: BinaryIO) -> None:
    to.parent.mkdir(parents=True, exist_ok=True)
    part = to.with_name(f".{to.name}.part")
    with part.open("wb") as out:
        shutil.copyfileobj(data, out, CHUNK)
    part.replace(to)  # a stream sees whole files only


def create_event(root: str, name: str, gallery: Iterable[tuple[str, BinaryIO]], references: Iterable[tuple[str, BinaryIO]] = (), c: Config = DEFAULT) -> Path:
    """Lays out an event below the events root; FileExistsError where there is one of that name.

    Gallery files keep their folders but for one in front that says it is the gallery; references lie flat.
    """
    event = Path(root) / c.events_root / (re.sub("[^A-Za-z0-9 _.-]+", "_", name).strip() or "Event")
    event.mkdir(parents=True, exist_ok=False)
    for folder in ("Gallery", "reference"):
        (event / folder).mkdir()
    for sent, data in gallery:
        parts = _relative(sent).parts
        parts = parts[1:] if parts and parts[0].lower() in FRONT else parts
        if parts:
            _write(event.joinpath("Gallery", *parts), data)
    for sent, data in references:
        if base := _relative(sent).name:
            _write(event / "reference" / base, data)
    return event
