"""The structure of a Java file: package, imports, types, methods and fields.

Comments and literals are blanked, then braces are matched and each member is read up to its body or
semicolon. Enums are not nodes; interfaces are classes; a field declaration gives its first name.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

_BLANK = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|.)*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_TYPE = re.compile(r"(?P<kind>class|interface|enum|record|@interface)\s+(?P<name>\w+)\s*(?P<rest>[^{]*)$", re.S)
_METHOD = re.compile(r"(?P<before>.*?)(?P<name>\w+)\s*\((?P<params>.*)\)\s*(?:throws\s[^{]*)?(?:default\s.*)?$", re.S)
_ANNOTATION = re.compile(r"@(?!interface\b)[\w.]+(?:\s*\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\))?")
_MODIFIER = re.compile(r"\b(?:public|protected|private|static|final|abstract|native|synchronized|transient|volatile|strictfp|default|sealed)\b|\bnon-sealed\b")
_BRACE, _FILLED = re.compile("[{}]"), re.compile(r"\S")
#: A parameter: its type, and its name with dimensions behind it.
_PARAMETER = re.compile(r"(.*[\s>\]])[\w$]+(?:\s*\[\s*\])*\s*", re.S)
#: Types longer than this are cut in signatures.
TYPE_CHARS = 50
_CALL = re.compile(r"(\w+)\s*\(")
#: Type arguments without others inside; a space before the bracket makes it a comparison.
_GENERIC = re.compile(r"(?<=\w)<[\w\s,.?&\[\]]*>")
_KEYWORDS = frozenset("if for while switch catch synchronized return new super this try do else throw assert".split())


def split_top(text: str, by: str = ",") -> list[str]:
    """Parts between separators that stand in no bracket."""
    parts, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([{") - (c in ">)]}")
        if c == by and not depth:
            parts.append(text[at:i])
            at = i + 1
    return [p.strip() for p in [*parts, text[at:]] if p.strip()]


def erased(kind: str) -> str:
    """A parameter's type as overloads are told apart: without type arguments, white space and its package.

    Packages are what stands before the first segment with an upper-case letter in front; where there is
    none, the last segment is the type. Varargs are arrays.
    """
    kept, depth = [], 0
    for c in kind:
        depth += (c == "<") - (c == ">" and depth > 0)
        if not depth and c != ">" and not c.isspace():
            kept.append(c)
    name, dimensions = re.fullmatch(r"(.*?)((?:\[\])*)", "".join(kept).replace("...", "[]")).groups()
    own = re.search(r"(?:^|\.)([A-Z].*)", name)
    return (own[1] if own else name.rpartition(".")[2]) + dimensions


def import_candidate(name: str, wildcard: bool) -> str:
    path = name.replace(".", "/")
    return f"{path}.*" if wildcard else f"{path}.java#{name.rsplit('.', 1)[-1]}"


def _close(text: str, at: int) -> int:
    """Place after the brace that closes the one at ``at``."""
    depth = 0
    for m in _BRACE.finditer(text, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def _members(text: str, at: int, end: int) -> Iterator[tuple[int, str, int, int]]:
    """(start, header, start of the body or -1, end) of each member between two places."""
    start = at
    depth = 0
    while at < end:
        c = text[at]
        depth += (c == "(") - (c == ")")
        if c == ";" and not depth:
            yield start, text[start:at], -1, at + 1
            start = at + 1
        elif c == "{" and not depth:
            stop = _close(text, at)
            if re.search(r"=[^=]*$", text[start:at]) and not _TYPE.search(text[start:at]):  # an initialiser goes on to its semicolon
                at = stop
                continue
            yield start, text[start:at], at, stop
            start = at = stop
            continue
        at += 1


class _Brackets:
    """Where the brackets of a text open and close, and how many commas stand directly inside each."""

    def __init__(self, text: str):
        self.opens, self.closes, self.commas = {}, {}, {}
        open_: list[int] = []
        for m in re.finditer(r"[()\[\]{},]", text):
            if m[0] in "([{":
                open_.append(m.start())
                self.commas[m.start()] = 0
            elif m[0] == ",":
                if open_:
                    self.commas[open_[-1]] += 1
            elif open_:
                self.opens[m.start()] = open_.pop()
                self.closes[self.opens[m.start()]] = m.start()


def _begin(text: str, end: int, brackets: _Brackets, known: dict[int, int]) -> int:
    """Where the expression begins that ends at ``end``: names, calls and subscripts joined by dots.

    ``known`` holds where the calls found so far begin, so a long chain is walked once.
    """
    at = end
    while True:
        while at and text[at - 1].isspace():
            at -= 1
        closed = at and text[at - 1] in ")]"
        if closed:
            if at - 1 not in brackets.opens:
                return at
            at = brackets.opens[at - 1]
        before = at
        while before and text[before - 1].isspace():
            before -= 1
        if closed and before and text[before - 1] in ")]":
            continue
        name = before
        while name and (text[name - 1].isalnum() or text[name - 1] in "_$"):
            name -= 1
        if name == before or (text[name:before] in _KEYWORDS and text[name:before] not in ("this", "super")):
            return at if closed else end
        if name in known:
            return known[name]
        at = name
        while name and text[name - 1].isspace():
            name -= 1
        if name and text[name - 1] == ".":
            at = name - 1
            continue
        made = re.search(r"\bnew$", text[max(0, name - 4) : name])
        return name - 3 if made else at


def _calls(text: str) -> list[dict]:
    """Calls and creations in order of their names, each with the text of what it is called on."""
    while (plain := _GENERIC.sub(lambda m: " " * len(m[0]), text)) != text:
        text = plain
    brackets, known, out = _Brackets(text), {}, []
    for m in _CALL.finditer(text):
        name, at, paren = m[1], m.start(), m.end() - 1
        if name in _KEYWORDS:
            continue
        dot = at
        while dot and text[dot - 1].isspace():
            dot -= 1
        chained = bool(dot) and text[dot - 1] == "."
        begin = _begin(text, dot - 1, brackets, known) if chained else at
        new = begin
        while new and text[new - 1].isspace():
            new -= 1
        lead = text.endswith("new", 0, new) and not (new > 3 and (text[new - 4].isalnum() or text[new - 4] in "_$"))
        made = re.fullmatch(r"(?:new\s+)?([\w.\s]+)", text[begin:paren]) if lead or text.startswith("new", begin) and text[begin + 3 : begin + 4].isspace() else None
        known[at] = new - 3 if lead else begin
        arity = brackets.commas[paren] + 1 if brackets.commas[paren] or _FILLED.search(text, paren + 1, brackets.closes.get(paren, len(text))) else 0
        if made:
            out.append({"name": re.sub(r"\s", "", made[1]), "arity": arity, "receiver": None, "is_creation": True})
        else:
            receiver = text[begin : dot - 1].strip() if chained else ""
            out.append({"name": name, "arity": arity, "receiver": receiver or None, "is_creation": False})
    return out


def java_nodes(path: str, data: bytes) -> Iterator[dict]:
    raw = data.decode("utf-8", "replace")
    text = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else '"' + re.sub(r"[^\n]", " ", m[0][1:-1]) + '"', raw)
    package = re.search(r"^\s*package\s+([\w.]+)\s*;", text, re.M)
    imports = [import_candidate(m[1], bool(m[2])) for m in re.finditer(r"^\s*import\s+(?:static\s+)?([\w.]+?)(\.\*)?\s*;", text, re.M)]
    yield {"uid": path, "name": path.rsplit("/", 1)[-1], "type": "file", "start_line": 1, "end_line": data.count(b"\n") + (not data.endswith(b"\n")), "body": raw, "diff_hash": hashlib.md5(data).hexdigest(), "package": package[1].replace(".", "/") if package else "", "imports": list(dict.fromkeys(imports))}
    shown = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0][0] == "/" else m[0], raw)
    yield from _inside((raw, text, shown, [m.start() for m in re.finditer("\n", raw)]), 0, len(text), path, True)


def _plain(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def parameter_types(params: str) -> list[str]:
    """Types of the parameters in order; varargs are none."""
    given = [_PARAMETER.fullmatch(re.sub(r"\bfinal\b", " ", p)) for p in split_top(params) if "..." not in p]
    return [_plain(m[1]) for m in given if m and m[1].strip()]


def _inside(source: tuple[str, str, str, list[int]], begin: int, end: int, parent: str, top: bool) -> Iterator[dict]:
    """Nodes between two places of a file: as it is, without what comments and literals hold, without comments, and where its lines end."""
    raw, text, shown, line_ends = source
    lead = f"{parent}#" if top else f"{parent}."
    for i, (start, header, body, stop) in enumerate(_members(text, begin, end)):
        start += len(header) - len(header.lstrip())
        header = header.lstrip()
        own = raw[start:stop]
        shared = {"parent_uid": parent, "ord": i, "body": own, "diff_hash": hashlib.md5(own.encode()).hexdigest(), "start_line": bisect_left(line_ends, start) + 1, "end_line": bisect_left(line_ends, stop) + 1}
        bare = _ANNOTATION.sub(lambda m: " " * len(m[0]), header)
        plain = _plain(bare)
        kind = _TYPE.search(bare)
        if kind and body >= 0:
            if kind["kind"] in ("enum", "record", "@interface"):
                continue
            rest = _plain(kind["rest"])
            generics = re.match(r"<(?:[^<>]|<[^<>]*>)*>", rest)
            rest = rest[generics.end() if generics else 0 :]
            bases = [re.sub(r"<.*>$", "", b) for clause in (re.findall(r"(?:extends|implements)\s+(.*?)(?=\s(?:extends|implements|permits)\s|$)", rest) if kind["kind"] == "class" else ()) for b in split_top(clause)]
            signature = f"{_plain(shown[start : start + kind.start()])} class {kind['name']}{generics[0] if generics else ''}".strip()
            yield shared | {"uid": lead + kind["name"], "name": kind["name"], "type": "class", "signature": signature, "inherits": bases}
            yield from _inside(source, body + 1, stop - 1, lead + kind["name"], False)
        elif not top and "(" in bare.split("=")[0] and (m := _METHOD.match(bare.split("{")[0])):
            types = parameter_types(m["params"])
            kinds, cut = [erased(t) for t in types], ", ".join(t if len(t) <= TYPE_CHARS else f"{t[: TYPE_CHARS - 3]}..." for t in types)
            signature = f"{_plain(shown[start : start + m.start('name')])} {m['name']}({cut})".strip()
            yield shared | {"uid": f"{lead}{m['name']}({', '.join(kinds)})", "name": m["name"], "type": "method", "signature": signature, "arity": len(kinds), "calls": _calls(text[body:stop]) if body >= 0 else []}
        elif not top and body < 0 and plain:
            declared = _MODIFIER.sub(" ", split_top(plain.split("=")[0])[0]).split()
            if len(declared) > 1 and declared[0] not in ("package", "import"):
                name, field = declared[-1].rstrip("[]"), re.sub(r"\s+", "", "".join(declared[:-1]))
                before = shown[start : start + len(split_top(bare.split("=")[0])[0]) + len(bare) - len(bare.lstrip())]
                yield shared | {"uid": lead + name, "name": name, "type": "field", "signature": re.sub(r"(?:\s*\[\s*\])+$", "", _plain(before)), "field_type": field}
