"""Copies the files of a manifest, from the executors, through Spark's own file systems where paths are local to all."""

from __future__ import annotations

import os
import shutil
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def copy_files(manifest: DataFrame, source_root: str, output_root: str) -> DataFrame:
    """event_name, person_folder, kind, dest_name, status per manifest row; roots must be shared by all executors.

    A copy goes to a temporary name first, so a task that runs twice leaves whole files.
    """

    def one(event: str, folder: str, kind: str, source: str, name: str) -> str:
        src = source if source.startswith("/") else os.path.join(source_root, source)
        if not os.path.isfile(src):
            return "missing"
        to = os.path.join(output_root, event, folder, kind)
        os.makedirs(to, exist_ok=True)
        part = os.path.join(to, f".{name}.{os.getpid()}")
        shutil.copy2(src, part)
        os.replace(part, os.path.join(to, name))
        return "copied"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["status"] = [one(*r) for r in b[["event_name", "person_folder", "kind", "source", "dest_name"]].itertuples(index=False)]
            yield b[["event_name", "person_folder", "kind", "dest_name", "status"]]

    return manifest.select("event_name", "person_folder", "kind", "source", "dest_name").mapInPandas(run, "event_name string, person_folder string, kind string, dest_name string, status string")


def write_crops(crops: DataFrame, source_root: str, output_root: str, decode: Callable[[bytes], np.ndarray | None], encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Cuts the rectangles of crops (event_name, a folder, source, crop, dest_name) out of their images and writes them.

    decode and encode stand for an image library.  One row per picture with a status: written, missing or unreadable.
    """
    folder = "person_folder" if "person_folder" in crops.columns else "folder"

    def one(event: str, where: str, source: str, name: str, box: tuple[int, int, int, int]) -> str:
        src = source if source.startswith("/") else os.path.join(source_root, source)
        if not os.path.isfile(src):
            return "missing"
        with open(src, "rb") as f:
            image = decode(f.read())
        if image is None:
            return "unreadable"
        to = os.path.join(output_root, event, where)
        os.makedirs(to, exist_ok=True)
        x1, y1, x2, y2 = box
        part = os.path.join(to, f".{name}.{os.getpid()}")
        with open(part, "wb") as f:
            f.write(encode(image[y1:y2, x1:x2]))
        os.replace(part, os.path.join(to, name))
        return "written"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            boxes = zip(b["x1"], b["y1"], b["x2"], b["y2"], strict=True)
            b["status"] = [one(*r, tuple(map(int, box))) for r, box in zip(b[["event_name", folder, "source", "dest_name"]].itertuples(index=False), boxes, strict=True)]
            yield b[["event_name", folder, "dest_name", "status"]]

    return crops.select("event_name", folder, "source", "dest_name", "crop.*").mapInPandas(run, f"event_name string, {folder} string, dest_name string, status string")
