"""Source files to nodes: one file gives many rows, where the files lie.

Files have path, content (binary) and lang. Python goes through the standard ``ast``, Java through a
scanner of its structure, both as small helpers inside ``mapInArrow``; HTML needs expressions only.

Of a Python file with errors the definitions around them are read, and ``parsed`` is false: whoever keeps a
graph can then keep what else the file held before. No file's content fails the job. Only direct children are nodes: code below
``if`` or ``try`` and nested functions are not, but their calls belong to the method around them.
"""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import ident
from graphloom.operators.java import java_nodes

NODE = (
    "uid string, name string, type string, path string, parent_uid string, lang string, ord int, signature string, body string, diff_hash string, start_line int, end_line int, "
    "inherits array<string>, field_type string, arity int, package string, imports array<string>, calls array<struct<name:string,arity:int,receiver:string,is_creation:boolean>>"
)
#: What ``extract`` gives: nodes, and whether their file could be parsed.
EXTRACTED = f"{NODE}, parsed boolean"
_NAMES = [x.split()[0] for x in re.sub(r"<.*?>+", "", EXTRACTED).split(", ")]
#: Nodes, or bytes of their files, that a task hands over together, about: a batch for each small file costs as much as its parsing.
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def _node(**given) -> dict:
    return dict.fromkeys(_NAMES) | {"inherits": [], "imports": [], "calls": [], "parsed": True} | given


def _anchor(path: str, module: str) -> str:
    """What stands before the import's first segment in the importing file's own folders."""
    folders = path.split("/")[:-1]
    first = module.split(".")[0]
    return "/".join(folders[: folders.index(first)]) if first in folders else ""


def module_candidates(path: str, module: str) -> list[str]:
    """Files that a dotted module can be, those below the anchor first."""
    base, anchor = module.replace(".", "/"), _anchor(path, module)
    return [f"{lead}{base}{end}" for lead in ([f"{anchor}/"] if anchor else []) + [""] for end in (".py", "/__init__.py")]


def _imports(tree: ast.Module, path: str) -> tuple[list[str], dict[str, str]]:
    """Candidates in order, and what each alias stands for."""
    package, out, alias = path.split("/")[:-1], [], {}
    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                out += module_candidates(path, a.name)
                if a.asname:
                    alias[a.asname] = a.name.split(".")[0]
        elif isinstance(node, ast.ImportFrom):
            parts = [node.module] if node.module else []
            if node.level:
                up = len(package) - node.level + (1 if path.endswith("/__init__.py") else 1)
                parts = (package[:up] if node.level <= len(package) else []) + parts
            module = ".".join(parts)
            for a in node.names if module else ():
                for m in module_candidates(path, module):
                    out += [f"{m}.*"] if a.name == "*" else [f"{m}#{a.name}", f"{m}#{a.name}(...)"]
                if a.asname:
                    alias[a.asname] = a.name
    return list(dict.fromkeys(out)), alias


def decoded(data: bytes) -> str:
    """A Python source by the coding it declares, without a byte order mark."""
    coding, _ = tokenize.detect_encoding(io.BytesIO(data).readline)
    return data.decode(coding).removeprefix("\ufeff")


class _Source:
    """Texts of nodes by line and byte column, both as ``ast`` counts them: lines end at \\n, \\r\\n and \\r."""

    def __init__(self, text: str):
        self.data = text.encode("utf-8", "replace")
        self.starts = [0, *(m.end() for m in re.finditer(rb"\r\n|\r|\n", self.data))]

    def text(self, node: ast.AST) -> str:
        return self.data[self.starts[node.lineno - 1] + node.col_offset : self.starts[node.end_lineno - 1] + node.end_col_offset].decode("utf-8", "replace")


def _calls(source: _Source, method: ast.AST, alias: dict[str, str]) -> list[dict]:
    out = []
    for node in ast.walk(method):
        if not isinstance(node, ast.Call):
            continue
        arity, f = len(node.args) + len(node.keywords), node.func
        if isinstance(f, ast.Name):
            out.append((node.lineno, node.col_offset, f.id, arity, None))
        elif isinstance(f, ast.Attribute) and isinstance(f.value, (ast.Name, ast.Attribute, ast.Call)):
            out.append((node.lineno, node.col_offset, f.attr, arity, source.text(f.value)))
    return [{"name": alias.get(n, n), "arity": k, "receiver": alias.get(r, r), "is_creation": False} for _, _, n, k, r in sorted(out, key=lambda x: x[:2])]


def _parameters(source: _Source, args: ast.arguments) -> list[str]:
    """Texts of the parameters with what belongs to them, in order."""
    plain = [*args.posonlyargs, *args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + args.defaults
    rows = [("", a, d) for a, d in zip(plain, defaults)]
    rows += [("*", args.vararg, None)] if args.vararg else []
    rows += [("", a, d) for a, d in zip(args.kwonlyargs, args.kw_defaults)]
    rows += [("**", args.kwarg, None)] if args.kwarg else []
    texts = []
    for star, a, d in rows:
        text = star + source.text(a)
        if d is not None:
            text += (" = " if a.annotation else "=") + source.text(d)
        texts.append(re.sub(r"\s+", " ", text))
    return texts


def file_node(path: str, data: bytes, text: str | None = None) -> dict:
    return {"uid": path, "name": path.rsplit("/", 1)[-1], "type": "file", "start_line": 1, "end_line": data.count(b"\n") + (not data.endswith(b"\n")), "body": data.decode("utf-8", "replace") if text is None else text, "diff_hash": hashlib.md5(data).hexdigest()}


_BLOCK = re.compile(r"[^\s#)\]}]")
_GOES_ON = re.compile(r"(?:elif|else|except|finally)\b")


def _parses(lines: list[str]) -> bool:
    text = "".join(lines)
    try:
        ast.parse(f"if 1:\n{text}" if text[:1].isspace() else text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


_TOKEN = re.compile(r"""#[^\r\n]*|(?P<triple>"{3}|'{3})(?:\\.|.)*?(?P=triple)|"(?:\\.|[^"\\\r\n])*"|'(?:\\.|[^'\\\r\n])*'|(?P<open>[(\[{])|(?P<close>[)\]}])""", re.S)
_STATEMENT = re.compile(r"[ \t]*(?:@|(?:async|def|class|import|from|return|with|while|try)\b)")


def _goes_on(text: str, lines: list[str]) -> list[bool]:
    """Whether each line begins inside a string, or inside brackets that close before another statement begins."""
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))
    line_of = lambda at: bisect_right(starts, at) - 1
    inside, brackets, opened = [False] * (len(lines) + 1), [], []
    for m in _TOKEN.finditer(text):
        if m["triple"]:
            for i in range(line_of(m.start()) + 1, line_of(m.end() - 1) + 1):
                inside[i] = True
        elif m["open"]:
            opened.append(line_of(m.start()))
        elif m["close"] and opened:
            brackets.append((opened.pop(), line_of(m.start())))
    begins = [i for i, line in enumerate(lines) if not inside[i] and _STATEMENT.match(line)]
    for first, last in brackets:
        if bisect_right(begins, first) == bisect_right(begins, last):
            inside[first + 1 : last + 1] = [True] * (last - first)
    return inside[: len(lines)]


def _mended(lines: list[str], goes_on: list[bool], indent: str = "") -> list[str]:
    """``lines`` with empty ones in place of the statements, at this indentation, that do not parse; in classes, of those inside."""
    inside = lambda line: line.startswith(indent) and bool(_BLOCK.match(line[len(indent) :])) and not _GOES_ON.match(line[len(indent) :])
    starts = [i for i, line in enumerate(lines) if not goes_on[i] and inside(line)]
    out = ["\n"] * (starts[0] if starts else len(lines))
    at = 0
    while at < len(starts):
        begin = starts[at]
        while at + 1 < len(starts) and lines[starts[at]].lstrip().startswith("@"):
            at += 1
        end = starts[at + 1] if at + 1 < len(starts) else len(lines)
        block, head = lines[begin:end], starts[at] - begin + 1
        if not _parses(block) and lines[starts[at]].lstrip().startswith("class") and _parses([*block[:head], f"{indent} pass\n"]):
            body = next((re.match(r"\s*", line)[0] for line in block[head:] if line.strip()), "")
            kept = _mended(block[head:], goes_on[begin + head : end], body) if len(body) > len(indent) else []
            block = [*block[:head], *kept, *[f"{indent} pass\n"] * (not any(map(str.strip, kept)))][: len(block)]
        out += block if _parses(block) else ["\n"] * (end - begin)
        at += 1
    return out


def python_nodes(path: str, data: bytes) -> Iterator[dict]:
    text = decoded(data)
    source, whole = _Source(text), True
    try:
        tree = ast.parse(text)
    except SyntaxError:
        lines = re.findall(r".*?(?:\r\n|\r|\n)|.+$", text, re.S)
        tree, whole = ast.parse("".join(_mended(lines, _goes_on(text, lines)))), False
    imports, alias = _imports(tree, path)
    yield _node(**file_node(path, data, text), imports=imports, package=".".join(path.split("/")[:-1]), parsed=whole)
    yield from _children(source, tree.body, path, True, alias)


def parsed_nodes(parse: Callable[[str, bytes], Iterator[dict]], path: str, data: bytes) -> list[dict]:
    """The nodes that ``parse`` finds in a file; of one uid the last stands. The file's own alone if it fails."""
    try:
        return list({r["uid"]: r for r in parse(path, data)}.values())
    except Exception:  # noqa: BLE001 - whatever a parser raises (MemoryError at deep nesting included) costs its file only
        return [_node(**file_node(path, data), parsed=False)]


def _children(source: _Source, body: list[ast.stmt], parent: str, top: bool, alias: dict[str, str]) -> Iterator[dict]:
    for i, node in enumerate(body):
        if not isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef, ast.Assign, ast.AnnAssign)):
            continue
        text = source.text(node)
        shared = {"parent_uid": parent, "ord": i, "body": text, "diff_hash": hashlib.md5(text.encode()).hexdigest(), "start_line": node.lineno, "end_line": node.end_lineno}
        lead = f"{parent}#" if top else f"{parent}."
        if isinstance(node, ast.ClassDef):
            bases = [source.text(x) for x in (*node.bases, *node.keywords)]
            yield _node(**shared, uid=lead + node.name, name=node.name, type="class", signature=f"class {node.name}" + (f"({', '.join(bases)})" if bases else ""), inherits=bases)
            yield from _children(source, node.body, lead + node.name, False, alias)
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            target = node.target if isinstance(node, ast.AnnAssign) else node.targets[0]
            name, kind = source.text(target), source.text(node.annotation) if isinstance(node, ast.AnnAssign) else ""
            yield _node(**shared, uid=lead + name, name=name, type="field", signature=f"{name}: {kind}" if kind else name, field_type=kind)
        else:
            given = _parameters(source, node.args)
            own = given[:1] and re.split("[=:]", given[0])[0].strip() in ("self", "cls")
            shown = ", ".join(p if len(p) <= 50 else p[:47] + "..." for p in given)
            yield _node(**shared, uid=f"{lead}{node.name}(...)", name=node.name, type="method", signature=f"def {node.name}({shown})", arity=len(given) - bool(own), calls=_calls(source, node, alias))


def _extractor(parse: Callable[[str, bytes], Iterator[dict]], lang: str) -> Callable:
    schema = pa.schema(
        [
            (n, pa.list_(pa.struct([("name", pa.string()), ("arity", pa.int32()), ("receiver", pa.string()), ("is_creation", pa.bool_())])))
            if n == "calls"
            else (n, pa.list_(pa.string()) if n in ("inherits", "imports") else pa.int32() if n in ("ord", "start_line", "end_line", "arity") else pa.bool_() if n == "parsed" else pa.string())
            for n in _NAMES
        ]
    )

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in schema], schema=schema)

    def run(batches):
        rows, size = [], 0
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows += [_node(**(r | {"path": path, "lang": lang})) for r in parsed_nodes(parse, path, data or b"")]
                size += len(data or b"")
                if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield batch_of(rows)
                    rows, size = [], 0
        if rows:
            yield batch_of(rows)

    return run


#: Extractors by language; more can be added.
EXTRACTORS: dict[str, Callable[[str, bytes], Iterator[dict]]] = {"python": python_nodes, "java": java_nodes}


def html_nodes(files: DataFrame) -> DataFrame:
    """The file node of each HTML file."""
    text = F.decode("content", "UTF-8")
    columns = {"uid": F.col("path"), "name": F.substring_index("path", "/", -1), "type": F.lit("file"), "path": F.col("path"), "lang": F.lit("html"), "body": text, "diff_hash": F.md5("content"), "start_line": F.lit(1), "end_line": F.size(F.split(text, "\n")) - F.when(text.endswith("\n"), 1).otherwise(0), "parsed": F.lit(True)}
    empty = {"inherits": F.array().cast("array<string>"), "imports": F.array().cast("array<string>"), "calls": F.array().cast("array<struct<name:string,arity:int,receiver:string,is_creation:boolean>>")}
    kinds = {x.split()[0]: x.split()[1] for x in re.sub(r"struct<.*?>", "s", EXTRACTED).split(", ")}
    return files.select(*(columns.get(n, empty.get(n, F.lit(None).cast(kinds[n]) if n not in empty else None)).alias(n) for n in _NAMES))


def extract(files: DataFrame) -> DataFrame:
    """Nodes of all files (path, content, lang), with ids; directories come from ``sources.tree``."""
    out = html_nodes(files.where("lang = 'html'"))
    for lang, parse in EXTRACTORS.items():
        out = out.unionByName(files.where(F.col("lang") == lang).mapInArrow(_extractor(parse, lang), EXTRACTED))
    parent = F.coalesce("parent_uid", ident.parent_path(F.col("path")))
    out = out.withColumn("parent_uid", parent).withColumn("id", ident.node_id(F.col("type"), F.col("uid")))
    return out


def import_candidates(structs: DataFrame) -> DataFrame:
    """(file_uid, ord, candidate, is_wildcard): what the imports of each file may name, in order."""
    rows = structs.where("type = 'file'").select(F.col("uid").alias("file_uid"), F.posexplode("imports").alias("ord", "import"))
    return rows.select("file_uid", "ord", F.regexp_replace("import", r"\.\*$", "").alias("candidate"), F.col("import").endswith(".*").alias("is_wildcard"))


def calls(structs: DataFrame) -> DataFrame:
    """(caller_uid, ord, name, arity, receiver, is_creation)."""
    rows = structs.where("type = 'method'").select(F.col("uid").alias("caller_uid"), F.posexplode("calls").alias("ord", "call"))
    return rows.select("caller_uid", "ord", "call.*")
