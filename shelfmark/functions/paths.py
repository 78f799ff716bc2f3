"""Column functions on file paths and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column) -> Column:
    """The last component; the path itself if that is empty."""
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last == "", path).otherwise(last)


def parent(path: Column) -> Column:
    """The directory of a path, without a slash at its end."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def extension(path: Column) -> Column:
    """What follows the last dot of the name, in lower case; empty for ``.bashrc`` and ``name``."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)^.+\.([^.]*)$", 1))


def stem(path: Column) -> Column:
    """The name without its last extension."""
    name = basename(path)
    cut = F.regexp_extract(name, r"(?s)^(.+)\.[^.]*$", 1)
    return F.when(cut == "", name).otherwise(cut)


def has_extension(path: Column, wanted: str) -> Column:
    """ASCII case is ignored, whatever the locale."""
    return path.rlike(rf"(?i)[.]{wanted}$")


def hidden(path: Column) -> Column:
    """Whether any component of a relative path starts with a dot."""
    return path.rlike(r"(^|/)\.")


def within(path: Column, directory: str) -> Column:
    """The directory itself or anything below it; a sibling with a longer name is not."""
    base = directory.rstrip("/")
    return (path == base) | path.startswith(f"{base}/")


# Folders of the system, which nothing may be done in.
SYSTEM_FOLDERS = ("/System", "/private", "/usr", "/bin", "/sbin", "/etc")


def protected(folder: Column, home: str, application: str, denied: tuple[str, ...] = ()) -> Column:
    """The root, home and the application's folder themselves; system and denied folders with all below."""
    out = folder.isin("", "/", home.rstrip("/"), application.rstrip("/"))
    for known in (*SYSTEM_FOLDERS, *denied):
        out |= within(folder, known)
    return out


def initial(name: Column) -> Column:
    """The first letter A to Z of a name in upper case, else the label for others."""
    first = F.substring(F.upper(F.ltrim(name)), 1, 1)
    return F.when(first.rlike("^[A-Z]$"), first).otherwise(F.lit("其他"))


def record_id(library: Column, platform: Column, volume: Column, native: Column, generation: Column) -> Column:
    """A stable id of a file's identity in a library: SHA-256 over NUL-terminated parts."""
    nul = F.lit("\0")
    parts = [F.coalesce(c, F.lit("")) for c in (library, platform, volume, native, generation)]
    return F.concat(F.lit("file_"), F.sha2(F.concat(*[x for p in parts for x in (p, nul)]).cast("binary"), 256))


def readable_size(size: Column) -> Column:
    """Bytes in units of 1024: one decimal below 10, none from there on."""
    out = None
    for power, unit in ((4, "TB"), (3, "GB"), (2, "MB"), (1, "KB")):
        value = size / float(1024**power)
        shown = F.concat(F.when(value < 10, F.format_string("%.1f", value)).otherwise(F.format_string("%.0f", value)), F.lit(f" {unit}"))
        out = F.when(size >= 1024**power, shown) if out is None else out.when(size >= 1024**power, shown)
    return out.otherwise(F.concat(size.cast("string"), F.lit(" B")))
