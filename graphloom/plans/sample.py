"""A source tree over the tables, for queries that need one: a file for each region, nation, supplier and customer.

Python files of suppliers import from those of nations and regions, Java files of customers from those of
nations. Texts are templates with ``$S``, ``$N``, ``$R`` and ``$C`` for keys. What must be found in them is
written down beside each template, by line, and is the source of the SQL; it was traced by hand.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = ("$S", "$N", "$R", "$C")

#: Files that one task makes and parses, about: the tables' keys are few bytes, which Spark would give to one task.
TASK_FILES = 4000


@dataclass(frozen=True)
class Template:
    """Files of one kind: a row of ``rows`` (SQL over the tables, columns s, n, r, c) gives one."""

    lang: str
    path: str
    text: str
    rows: str
    #: uid after the path, kind, parent's after the path, signature, arity, first and last line
    nodes: tuple[tuple[str, str, str, str, int | None, int, int], ...]
    #: source and target uid, and the kind of edge that a rule finds; ``@`` is the file's own path
    edges: tuple[tuple[str, str, str], ...] = ()
    #: import candidate, what it names, whether it is a wildcard
    imports: tuple[tuple[str, str, bool], ...] = ()


EXACT, FUZZY = "depends_on", "depends_on_fuzzy"
NATION, REGION, UTIL, BASE = "src/lib/n$N.py", "src/lib/g$R.py", "src/lib/util.py", "com/base/B$N.java"

TEMPLATES = (
    Template("python", REGION, "class G$R:\n    def rank(self, k):\n        return k\n", "SELECT NULL AS s, NULL AS n, r_regionkey AS r, NULL AS c FROM region", (("#G$R", "class", "", "class G$R", None, 1, 3), ("#G$R.rank(...)", "method", "#G$R", "def rank(self, k)", 1, 2, 3))),
    Template("python", UTIL, "def pad(text, width):\n    return text\n", "SELECT NULL AS s, NULL AS n, NULL AS r, NULL AS c FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)", (("#pad(...)", "method", "", "def pad(text, width)", 2, 1, 2),)),
    Template(
        "python",
        NATION,
        "class N$N:\n    def rank(self, a, b: int = 1, *rest):\n        return a\n\n    def name$N(self):\n        return 1\n",
        "SELECT NULL AS s, n_nationkey AS n, NULL AS r, NULL AS c FROM nation",
        (("#N$N", "class", "", "class N$N", None, 1, 6), ("#N$N.rank(...)", "method", "#N$N", "def rank(self, a, b: int = 1, *rest)", 3, 2, 3), ("#N$N.name$N(...)", "method", "#N$N", "def name$N(self)", 0, 5, 6)),
    ),
    Template(
        "python",
        "src/app/r$R/s$S.py",
        "from lib.n$N import N$N\nfrom lib.g$R import *\nfrom lib.util import pad as padded\n\n\nclass S$S(N$N):\n    home: N$N\n\n"
        "    def top(self, x):\n        return self.rank(x)\n\n    def away(self):\n        return self.home.name$N()\n\n    def near(self):\n        return self.top(1)\n\n"
        "    def wide(self, text):\n        return padded(text, 2)\n\n    def made(self):\n        return N$N()\n\n    def odd(self, thing):\n        return thing.rank(1)\n\n    def pick(self, n):\n        return n.rank(1)\n",
        "SELECT s_suppkey AS s, n_nationkey AS n, n_regionkey AS r, NULL AS c FROM supplier JOIN nation ON n_nationkey = s_nationkey",
        (
            ("#S$S", "class", "", "class S$S(N$N)", None, 6, 28),
            ("#S$S.home", "field", "#S$S", "home: N$N", None, 7, 7),
            *((f"#S$S.{name}(...)", "method", "#S$S", f"def {name}({args})", args.count(","), line, line + 1) for name, args, line in (("top", "self, x", 9), ("away", "self", 12), ("near", "self", 15), ("wide", "self, text", 18), ("made", "self", 21), ("odd", "self, thing", 24), ("pick", "self, n", 27))),
        ),
        (
            ("@#S$S", f"{NATION}#N$N", EXACT),  # by import, by base and by field
            ("@#S$S", f"{UTIL}#pad(...)", EXACT),  # by import
            ("@#S$S.top(...)", f"{NATION}#N$N.rank(...)", EXACT),  # inherited, through self
            ("@#S$S.away(...)", f"{NATION}#N$N.name$N(...)", EXACT),  # through a typed field
            ("@#S$S.near(...)", "@#S$S.top(...)", EXACT),  # a sibling
            ("@#S$S.wide(...)", f"{UTIL}#pad(...)", EXACT),  # through an alias
            ("@#S$S.made(...)", f"{NATION}#N$N", EXACT),  # a type by its import
            ("@#S$S.odd(...)", f"{NATION}#N$N.rank(...)", FUZZY),  # two candidates, by import and by wildcard
            ("@#S$S.odd(...)", f"{REGION}#G$R.rank(...)", FUZZY),
            ("@#S$S.pick(...)", f"{NATION}#N$N.rank(...)", EXACT),  # of two the one whose class holds the receiver's name
        ),
        (("lib/n$N.py#N$N", f"{NATION}#N$N", False), ("lib/n$N.py#N$N(...)", f"{NATION}#N$N", False), ("lib/g$R.py", REGION, True), ("lib/util.py#pad", f"{UTIL}#pad(...)", False), ("lib/util.py#pad(...)", f"{UTIL}#pad(...)", False)),
    ),
    Template(
        "java",
        BASE,
        "package com.base;\npublic class B$N {\n    public int find(String name, int n) { return n; }\n    public int find(int n) { return n; }\n}\n",
        "SELECT NULL AS s, n_nationkey AS n, NULL AS r, NULL AS c FROM nation",
        (("#B$N", "class", "", "public class B$N", None, 2, 5), ("#B$N.find(String, int)", "method", "#B$N", "public int find(String, int)", 2, 3, 3), ("#B$N.find(int)", "method", "#B$N", "public int find(int)", 1, 4, 4)),
    ),
    Template(
        "java",
        "com/shop/C$C.java",
        "package com.shop;\nimport com.base.B$N;\npublic class C$C extends B$N {\n    private B$N inner;\n    public int count(final java.lang.String name) { return inner.find(name, 1); }\n"
        "    public B$N made() { return new B$N(); }\n    int again(java.util.List<String> a) { return count(a.get(0)); }\n}\n",
        "SELECT NULL AS s, c_nationkey AS n, NULL AS r, c_custkey AS c FROM customer",
        (
            ("#C$C", "class", "", "public class C$C", None, 3, 8),
            ("#C$C.inner", "field", "#C$C", "private B$N inner", None, 4, 4),
            ("#C$C.count(String)", "method", "#C$C", "public int count(java.lang.String)", 1, 5, 5),
            ("#C$C.made()", "method", "#C$C", "public B$N made()", 0, 6, 6),
            ("#C$C.again(List)", "method", "#C$C", "int again(java.util.List<String>)", 1, 7, 7),
        ),
        (
            ("@#C$C", f"{BASE}#B$N", EXACT),  # by import, by base and by field
            ("@#C$C.count(String)", f"{BASE}#B$N.find(String, int)", EXACT),  # a field's type, by name and number of arguments
            ("@#C$C.made()", f"{BASE}#B$N", EXACT),  # a creation
            ("@#C$C.again(List)", "@#C$C.count(String)", EXACT),  # a sibling with as many parameters
        ),
        ((f"{BASE}#B$N", f"{BASE}#B$N", False),),
    ),
)


def _filled(template: str) -> Column:
    out = F.lit(template)
    for token in TOKENS:
        out = F.replace(out, F.lit(token), F.coalesce(F.col(token[1].lower()).cast("string"), F.lit("")))
    return out


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content and lang of the whole tree."""
    names = ("region", "nation", "supplier", "customer")
    tables = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}
    made = []
    for t in TEMPLATES:
        rows = spark.sql(re.sub(rf"(FROM|JOIN) ({'|'.join(names)})", r"\1 {\2}", t.rows), **tables)
        tasks = -(-rows.count() // TASK_FILES)
        rows = rows.repartition(tasks, *rows.columns) if tasks > 1 else rows
        made.append(rows.select(_filled(t.path).alias("path"), F.encode(_filled(t.text), "UTF-8").alias("content"), F.lit(t.lang).alias("lang")))
    out = made[0]
    for df in made[1:]:
        out = out.unionByName(df)
    return out


# -- the same in SQL ------------------------------------------------------------------------------------


def _quoted(template: str | None, path: str = "") -> str:
    """SQL for a filled template; ``@`` at its begin is ``path``."""
    if template is None:
        return "NULL"
    text = path + template[1:] if template.startswith("@") else template
    out = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for token in TOKENS:
        if token in text:
            out = f"replace({out}, '{token}', {token[1].lower()}::VARCHAR)"
    return out


def _rows(pick) -> str:
    """UNION of a row for each of ``pick(template)``, lists of SQL expressions, and each of the template's files."""
    return "\n  UNION ALL ".join(f"SELECT {', '.join(row)} FROM ({t.rows})" for t in TEMPLATES for row in pick(t))


def _nodes(t: Template):
    lines = t.text.split("\n")
    yield [_quoted(t.path), "'file'", _quoted(t.path.rpartition("/")[0]), "NULL", "NULL::INTEGER", "1", str(len(lines) - 1), f"md5({_quoted(t.text)})"]
    for uid, kind, parent, signature, arity, first, last in t.nodes:
        body = "\n".join(lines[first - 1 : last]).lstrip()
        yield [_quoted(t.path + uid), f"'{kind}'", _quoted(t.path + parent), _quoted(signature), "NULL" if arity is None else str(arity), str(first), str(last), f"md5({_quoted(body)})"]


NODES_SQL = f"nodes(uid, type, parent_uid, signature, arity, start_line, end_line, diff_hash) AS (\n  {_rows(_nodes)})"
FOLDERS_SQL = r"""folders(uid, parent_uid) AS (
  SELECT DISTINCT parent_uid, CASE WHEN contains(parent_uid, '/') THEN regexp_replace(parent_uid, '/[^/]*$', '') ELSE '.' END FROM nodes WHERE type = 'file'
  UNION SELECT parent_uid, CASE WHEN contains(parent_uid, '/') THEN regexp_replace(parent_uid, '/[^/]*$', '') WHEN parent_uid <> '.' THEN '.' END FROM folders WHERE parent_uid IS NOT NULL)"""
CALLS_SQL = "found(source_id, target_id, edge_type) AS (\n  " + _rows(lambda t: [[_quoted(s, t.path), _quoted(x, t.path), f"'{kind}'"] for s, x, kind in t.edges]) + ")"
IMPORTS_SQL = _rows(lambda t: [[f"{_quoted(t.path)} AS file_uid", f"{_quoted(c)} AS candidate", f"{_quoted(x)} AS target", f"{'true' if wild else 'false'} AS is_wildcard"] for c, x, wild in t.imports])
