"""Paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, IMAGE_EXTENSIONS, REFERENCE_EXTENSIONS, Config


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]+$", "")


def is_image(path: Column, reference: bool = False) -> Column:
    return extension(path).isin(*(REFERENCE_EXTENSIONS if reference else IMAGE_EXTENSIONS))


def event_of(path: Column, c: Config = DEFAULT) -> Column:
    """The event directory of a path under the events root, else null."""
    found = F.regexp_extract(path, rf"(?:^|/)\Q{c.events_root}\E/([^/]+)/", 1)
    return F.when(found != "", found)


def in_folder(path: Column, folder: str, c: Config = DEFAULT) -> Column:
    return path.rlike(rf"(?:^|/)\Q{c.events_root}\E/[^/]+/\Q{folder}\E/")


def canonical(path: Column, root: str, c: Config = DEFAULT) -> Column:
    """Portable project-relative id: absolute paths must lie under root, relative ones get the events prefix."""
    events, prefix = f"{root.rstrip('/')}/{c.events_root}/", f"{c.events_root}/"
    inside = F.concat(F.lit(prefix), F.substring(path, len(events) + 1, F.length(path)))
    outside = F.raise_error(F.concat(F.lit("not under the events root: "), path)).cast("string")
    return F.when(path.startswith(events), inside).when(path.startswith("/"), outside).when(path.startswith(prefix), path).otherwise(F.concat(F.lit(prefix), path))


def resolved(image_id: Column, root: str) -> Column:
    return F.when(image_id.startswith("/"), image_id).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), image_id))


def portable(path: Column, c: Config = DEFAULT) -> Column:
    """A legacy path from its events marker on (found in any case, kept in its own); unchanged without a marker."""
    p = F.translate(F.trim(path), "\\", "/")
    at = F.locate(f"/{c.events_root}/", F.lower(p))
    return F.when(at > 0, F.substring(p, at + 1, F.length(p))).otherwise(path)


def person_name(path: Column) -> Column:
    return F.trim(F.substring_index(F.trim(stem(path)), " - ", 1))


def phone_number(path: Column) -> Column:
    return F.coalesce(F.trim(F.get(F.split(F.trim(stem(path)), " - ", 2), F.lit(1))), F.lit(""))


def person_folder(name: Column) -> Column:
    """A name that is safe as a folder."""
    safe = F.translate(F.coalesce(name, F.lit("")), '<>:"/\\|?*', "_________")
    safe = F.regexp_replace(F.trim(F.regexp_replace(safe, r"\s+", " ")), r"\.+$", "")
    return F.when(safe == "", "Unknown Person").otherwise(safe)


def output_name(image_id: Column, observation_id: Column) -> Column:
    name = basename(image_id)
    return F.when(name != "", name).otherwise(F.concat(F.lit("observation_"), observation_id.cast("string"), F.lit(".jpg")))


def event_folder(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9 _.-]+", "_")


def log_name(name: Column) -> Column:
    """As event_folder, but without spaces."""
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


def is_safe_relative(path: Column) -> Column:
    """Neither absolute nor climbing."""
    return ~path.rlike(r"^/|(^|/)\.\.(/|$)")


def short_hash(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 8)


def query_literal(text: Column) -> Column:
    """Backslashes and quotes escaped."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))


def label(key: Column) -> Column:
    return F.initcap(F.replace(F.lower(key), F.lit("_"), F.lit(" ")))


def url(path: Column) -> Column:
    """Percent-encoded path; slashes stay."""
    return F.replace(F.replace(F.url_encode(path), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def event_output(root: str, event: Column, c: Config = DEFAULT) -> Column:
    return F.concat(F.lit(f"{root.rstrip('/')}/{c.output_root}/"), event)
