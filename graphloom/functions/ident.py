"""Identity of graph nodes.

A uid is ``relative/path.ext#Symbol``; dots stand inside the symbol only, and the root is ``.``. An id is
a letter for the kind, a dash and the first ten hexadecimal digits of the MD5 of the uid.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letter of each kind (fixed values: ids are shared between tables).
PREFIXES = {"directory": "D", "file": "F", "class": "C", "method": "M", "field": "V"}


def id_of(kind: str, uid: str) -> str:
    return f"{PREFIXES.get(kind, 'S')}-{hashlib.md5(uid.encode()).hexdigest()[:10]}"


def _prefix(kind: Column) -> Column:
    out = F.lit("S")
    for name, letter in PREFIXES.items():
        out = F.when(kind == name, letter).otherwise(out)
    return out


def node_id(kind: Column, uid: Column) -> Column:
    return F.concat(_prefix(kind), F.lit("-"), F.substring(F.md5(uid), 1, 10))


def kind_of(ref: str) -> str | None:
    """The kind that an id names, or None for anything but an id."""
    letters = {v: k for k, v in PREFIXES.items()}
    return letters.get(ref[0]) if len(ref) == 12 and ref[1] == "-" else None


def diff_hash(text: Column) -> Column:
    """MD5 of a node's bytes."""
    return F.md5(text)


def file_uid(uid: Column) -> Column:
    return F.substring_index(uid, "#", 1)


def short_uid(uid: Column) -> Column:
    """The member part, ``#member``; a uid without one stays."""
    return F.regexp_replace(uid, "^[^#]*#", "#")


def suffix_key(uid: Column) -> Column:
    """Last segment of the path, the bucket of suffix look-ups."""
    return F.substring_index(uid, "/", -1)


def suffixes(uid: Column) -> Column:
    """All that stands after a slash: ``a/b/c`` gives ``b/c`` and ``c``."""
    parts = F.split(uid, "/")
    return F.transform(F.slice(parts, 2, F.size(parts)), lambda _, i: F.array_join(F.slice(parts, i + 2, F.size(parts)), "/"))


def parent_path(path: Column) -> Column:
    """Directory that holds a path; ``.`` for one at the top."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit("."))


def in_subtree(path: Column, root: str) -> Column:
    """Whether a path is ``root`` or below it; prefixes are compared as they stand, without wildcards."""
    return F.lit(True) if root == "." else (path == root) | path.startswith(f"{root}/")


def near_uid(uid: Column, path: Column, root: str) -> Column:
    """The neighbourhood of a uid: itself, its members, everything in its file or below its directory."""
    return (uid == root) | uid.startswith(f"{root}.") | uid.startswith(f"{root}#") | (path == root) | uid.startswith(f"{root}/")


STALE = "[STALE] "


def staled(description: Column) -> Column:
    return F.when(description != "", F.concat(F.lit(STALE), description)).otherwise(description)


def is_stale(description: Column) -> Column:
    return F.coalesce(description.startswith(STALE), F.lit(False))


def unstaled(description: Column) -> Column:
    return F.regexp_replace(description, r"^\[STALE\] ", "")
