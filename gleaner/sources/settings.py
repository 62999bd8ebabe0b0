"""Settings files: `.env` lines and Python constants."""

from __future__ import annotations

import ast
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def env_rows(lines: DataFrame) -> DataFrame:
    """key and value of each line of column `value` that sets one; blank lines, comments and lines without '=' don't."""
    line = F.trim("value")
    parts = F.split(line, "=", 2)
    rows = lines.where((line != "") & ~line.startswith("#") & F.contains(line, F.lit("=")))
    # Double quotes go first, then single ones: what double quotes inside single ones enclose stays.
    value = F.regexp_replace(F.regexp_replace(F.trim(F.element_at(parts, 2)), '^"+|"+$', ""), "^'+|'+$", "")
    return rows.withColumn("key", F.trim(F.element_at(parts, 1))).withColumn("value", value)


def read_env(path: str) -> dict[str, str]:
    found = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        key, eq, value = line.strip().partition("=")
        if eq and not key.startswith("#"):
            found[key.strip()] = value.strip().strip('"').strip("'")
    return found


def write_env(path: str, updates: dict[str, str]) -> None:
    """Sets keys where they stand and adds the others at the end; the file as it was first is kept beside it, with `.bak`."""
    file, keep, left = Path(path), Path(f"{path}.bak"), dict(updates)
    if file.exists() and not keep.exists():
        keep.write_bytes(file.read_bytes())
    lines = file.read_text(encoding="utf-8").splitlines() if file.exists() else []
    for n, line in enumerate(lines):
        key = line.partition("=")[0].strip()
        if "=" in line and not line.lstrip().startswith("#") and key in left:
            lines[n] = f"{key}={left.pop(key)}"
    file.write_text("\n".join([*lines, *(f"{k}={v}" for k, v in left.items())]) + "\n", encoding="utf-8")


def _constants(tree: ast.Module):
    for node in tree.body:
        if isinstance(node, ast.Assign) and len(node.targets) == 1 and isinstance(node.targets[0], ast.Name):
            yield node.targets[0].id, node.value


def read_constants(path: str) -> dict:
    """Literals that a Python file assigns at its top level; the last assignment of a name counts.  No file: none."""
    found, file = {}, Path(path)
    for name, value in _constants(ast.parse(file.read_text(encoding="utf-8") if file.exists() else "")):
        try:
            found[name] = ast.literal_eval(value)
        except (ValueError, TypeError, SyntaxError, MemoryError, RecursionError):
            continue
    return found


def write_constants(path: str, updates: dict) -> None:
    """Replaces literals in place; the file as it was before the first change is kept beside it, with `.bak`."""
    file = Path(path)
    text = file.read_text(encoding="utf-8")
    raw = text.encode()
    starts = [0]
    for line in raw.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    spots = {n: (starts[v.lineno - 1] + v.col_offset, starts[v.end_lineno - 1] + v.end_col_offset) for n, v in _constants(ast.parse(text))}
    if unknown := updates.keys() - spots.keys():
        raise KeyError(f"no such constants: {sorted(unknown)}")
    keep = Path(f"{path}.bak")
    if not keep.exists():
        keep.write_bytes(raw)
    for name in sorted(updates, key=lambda n: -spots[n][0]):
        a, b = spots[name]
        raw = raw[:a] + repr(updates[name]).encode() + raw[b:]
    file.write_bytes(raw)
