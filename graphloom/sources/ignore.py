"""Ignore rules with the meaning of a gitignore, as one column expression.

A pattern without an inner slash matches at any depth, one with it from the root; a slash at the end
means directories only; ``!`` takes back; the last rule that matches a path stands. A path is ignored as
well when one of the directories above it is, and then nothing below can be taken back.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column
from pyspark.sql import functions as F



def _sections(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in filter(None, text.splitlines()):
        if line.startswith("[") and line.endswith("]"):
            rules = out.setdefault(line[1:-1], [])
        elif not line.startswith("#"):
            rules.append(line)
    return out


_RULES = _sections(files("graphloom.sources").joinpath("ignore_rules.txt").read_text(encoding="utf-8"))
#: Never scanned, whatever a project says.
ALWAYS = _RULES.pop("always")
#: Used where a project has no rules of its own, by language.
DEFAULTS = _RULES


def pattern_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """(regular expression over a whole path, directories only, taken back), or None for a blank or comment."""
    line = pattern.rstrip("\n").rstrip(" ")
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    line = line[1:] if back else line.removeprefix("\\")
    folder = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    out, i = "", 0
    line = line.lstrip("/")
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 2 :]:
            end = line.index("]", i + 2)
            out, i = out + "[" + line[i + 1 : end].replace("!", "^", 1) + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    return ("" if anchored else "(?:.*/)?") + out, folder, back


def is_ignored(path: Column, is_dir: Column, rules: list[str]) -> Column:
    """Whether a path relative to the project is ignored by ``ALWAYS`` or by ``rules``."""
    return _by_rules(path, is_dir, list(ALWAYS)) | _by_rules(path, is_dir, rules)


def _by_rules(path: Column, is_dir: Column, rules: list[str]) -> Column:
    compiled = [c for c in map(pattern_regex, rules) if c]
    if not compiled:
        return F.lit(False)

    def own(p: Column, folder: Column) -> Column:
        hit = F.lit(False)
        for regex, only_dir, back in compiled:  # the last match is the outermost condition
            match = p.rlike(f"^{regex}$") & (folder if only_dir else F.lit(True))
            hit = F.when(match, F.lit(not back)).otherwise(hit)
        return hit

    parts = F.split(path, "/")
    above = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: F.array_join(F.slice(parts, 1, i + 1), "/"))
    return (path != ".") & (F.exists(above, lambda p: own(p, F.lit(True))) | own(path, is_dir))
