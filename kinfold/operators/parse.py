"""Component records from script sources with markup: a tolerant scanner, a bracket tree, and a walk over it.

The scanner knows strings, templates, comments, regular expressions and markup elements; brackets make a tree, so that a component
is a name, a parameter group and a body. Broken source gives an error row instead of components.
"""

from __future__ import annotations

import bisect
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

IGNORE_FILE, IGNORE_NEXT = "kinfold-ignore-file", "kinfold-ignore-next"
STYLE_EXTENSIONS = (".css", ".scss", ".sass", ".less")
MARKUP = (".tsx", ".js", ".jsx", ".mjs", ".cjs")
_NAME = re.compile(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*")
_NUMBER = re.compile(r"0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.|[=!]==?|&&|\|\||\?\?|\+\+|--|<=|>=|\*\*|.", re.S)
_PASCAL = re.compile(r"[A-Z][A-Za-z0-9_$]*$")
_BLOCKS = {"if", "for", "while", "switch", "catch", "with"}
_BEFORE_VALUE = {"return", "typeof", "case", "do", "else", "in", "instanceof", "new", "void", "delete", "throw", "await", "yield", "default", "of", "extends"}
_STARTS = {"export", "const", "let", "var", "function", "class", "import", "return", "if", "for"}
_CLOSE = {"(": ")", "[": "]", "{": "}"}


@dataclass
class Node:
    kind: str  # name, number, string, template, regex, punct, group, markup
    value: str
    start: int
    end: int = 0
    items: list["Node"] = field(default_factory=list)
    # of markup: attributes as (name, value node or None); items are the children
    attributes: list[tuple[str, "Node | None"]] = field(default_factory=list)


class Broken(ValueError):
    pass


class Scanner:
    def __init__(self, source: str, markup: bool):
        self.s, self.i, self.markup = source, 0, markup

    def blank(self) -> None:
        s = self.s
        while self.i < len(s):
            if s[self.i].isspace() or s[self.i] == "﻿":
                self.i += 1
            elif s.startswith("//", self.i):
                end = s.find("\n", self.i)
                self.i = len(s) if end < 0 else end
            elif s.startswith("/*", self.i):
                end = s.find("*/", self.i + 2)
                if end < 0:
                    raise Broken("a comment isn't closed")
                self.i = end + 2
            else:
                return

    def nodes(self, close: str = "") -> list[Node]:
        """The nodes up to the closing bracket, which is taken too."""
        out: list[Node] = []
        while True:
            self.blank()
            if self.i >= len(self.s):
                if close:
                    raise Broken(f"{close} is missing")
                return out
            c = self.s[self.i]
            if c == close:
                self.i += 1
                return out
            if c in ")]}":
                raise Broken(f"unexpected {c}")
            out.append(self.node(out))

    def node(self, before: list[Node]) -> Node:
        s, at = self.s, self.i
        c = s[at]
        if c in _CLOSE:
            self.i += 1
            items = self.nodes(_CLOSE[c])
            return Node("group", c, at, self.i, items)
        if c in "\"'":
            return self.string(c)
        if c == "`":
            return self.template()
        if m := _NAME.match(s, at):
            self.i = m.end()
            return Node("name", m[0], at, self.i)
        if m := _NUMBER.match(s, at):
            self.i = m.end()
            return Node("number", m[0], at, self.i)
        if not ends_value(before):
            if c == "/":
                return self.regex()
            if c == "<" and self.markup and re.match(r"<(?:>|[A-Za-z_$])", s[at : at + 2]) and not re.match(r"<\w+\s*(?:,|extends\b)[^>]*>\s*\(", s[at : at + 200]):
                return self.element()
        m = _PUNCT.match(s, at)
        self.i = m.end()
        return Node("punct", m[0], at, self.i)

    def string(self, quote: str) -> Node:
        m = re.compile(rf"{quote}((?:\\[\s\S]|[^\\{quote}\n])*){quote}").match(self.s, self.i)
        if not m:
            raise Broken("a string isn't closed")
        at, self.i = self.i, m.end()
        return Node("string", re.sub(r"\\(.)", r"\1", m[1]), at, self.i)

    def template(self) -> Node:
        at, s = self.i, self.s
        self.i += 1
        items: list[Node] = []
        while self.i < len(s) and s[self.i] != "`":
            if s[self.i] == "\\":
                self.i += 2
            elif s.startswith("${", self.i):
                self.i += 2
                items += self.nodes("}")
            else:
                self.i += 1
        if self.i >= len(s):
            raise Broken("a template isn't closed")
        self.i += 1
        return Node("template", s[at + 1 : self.i - 1], at, self.i, items)

    def regex(self) -> Node:
        m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*").match(self.s, self.i)
        at = self.i
        self.i = m.end() if m else at + 1
        return Node("regex" if m else "punct", self.s[at : self.i], at, self.i)

    def tag(self) -> str:
        m = re.compile(r"[A-Za-z_$][\w$.:-]*").match(self.s, self.i)
        self.i = m.end() if m else self.i
        return m[0] if m else ""

    def element(self) -> Node:
        s, at = self.s, self.i
        self.i += 1
        self.blank()
        node = Node("markup", self.tag(), at)
        while True:
            self.blank()
            if s.startswith("/>", self.i):
                self.i += 2
                node.end = self.i
                return node
            if s.startswith(">", self.i):
                self.i += 1
                break
            if s.startswith("{", self.i):
                self.i += 1
                inside = self.nodes("}")
                node.attributes.append(("...", Node("group", "{", at, self.i, inside)))
                continue
            if s.startswith("<", self.i) and not node.attributes:  # type arguments
                self.i = s.index(">", self.i) + 1
                continue
            name = self.tag()
            if not name:
                raise Broken("an attribute is expected")
            self.blank()
            value = None
            if s.startswith("=", self.i):
                self.i += 1
                self.blank()
                c = s[self.i : self.i + 1]
                if c in ("'", '"') and c:
                    end = s.find(c, self.i + 1)
                    if end < 0:
                        raise Broken("an attribute isn't closed")
                    value = Node("string", s[self.i + 1 : end], self.i, end + 1)
                    self.i = end + 1
                elif c == "{":
                    start = self.i
                    self.i += 1
                    value = Node("group", "{", start, 0, self.nodes("}"))
                    value.end = self.i
                elif c == "<":
                    value = self.element()
            node.attributes.append((name, value))
        while True:
            end = min((k for k in (s.find("<", self.i), s.find("{", self.i)) if k >= 0), default=-1)
            if end < 0:
                raise Broken(f"<{node.value}> isn't closed")
            if s[self.i : end].strip():
                node.items.append(Node("text", s[self.i : end].strip(), self.i, end))
            self.i = end
            if s.startswith("</", end):
                self.i += 2
                self.blank()
                if self.tag() != node.value:
                    raise Broken(f"<{node.value}> isn't closed")
                self.blank()
                if not s.startswith(">", self.i):
                    raise Broken("> is missing")
                self.i += 1
                node.end = self.i
                return node
            if s[end] == "{":
                self.i += 1
                node.items.append(Node("group", "{", end, 0, self.nodes("}")))
                node.items[-1].end = self.i
            else:
                node.items.append(self.element())


def ends_value(before: list[Node]) -> bool:
    if not before:
        return False
    last = before[-1]
    if last.kind == "name":
        return last.value not in _BEFORE_VALUE
    if last.kind == "group":
        return last.value != "{" and not (last.value == "(" and len(before) > 1 and before[-2].kind == "name" and before[-2].value in _BLOCKS)
    return last.kind in ("number", "string", "template", "regex", "markup") or last.value in ("++", "--")


def is_name(n: Node | None, value: str | None = None) -> bool:
    return n is not None and n.kind == "name" and (value is None or n.value == value)


def is_punct(n: Node | None, value: str) -> bool:
    return n is not None and n.kind == "punct" and n.value == value


def is_group(n: Node | None, value: str) -> bool:
    return n is not None and n.kind == "group" and n.value == value


def at(nodes: list[Node], i: int) -> Node | None:
    return nodes[i] if 0 <= i < len(nodes) else None


@dataclass
class Function:
    """A function-like value: its parameter group or lone name, the nodes of its body, and where it ends."""

    params: Node | None
    body: list[Node]
    end: int
    after: int
    name: str | None = None


def _arrow_body(nodes: list[Node], i: int) -> tuple[list[Node], int]:
    """The nodes of an arrow function's body from i on, and the index after them."""
    if is_group(at(nodes, i), "{"):
        return nodes[i].items, i + 1
    j = i
    while j < len(nodes) and not (nodes[j].kind == "punct" and nodes[j].value in ";,"):
        if j > i and nodes[j].kind == "name" and nodes[j].value in _STARTS and ends_value(nodes[:j]):
            break
        j += 1
    return nodes[i:j], j


def _skip_type(nodes: list[Node], i: int, stop: str) -> int:
    """Past a type annotation that begins with : at i."""
    if not is_punct(at(nodes, i), ":"):
        return i
    while i < len(nodes) and not is_punct(nodes[i], stop) and not (stop == "{" and is_group(nodes[i], "{")):
        i += 1
    return i


def function_at(nodes: list[Node], i: int) -> Function | None:
    """The function that begins at i: function, async function, or an arrow function."""
    if is_name(at(nodes, i), "async"):
        i += 1
    if is_name(at(nodes, i), "function"):
        i += 1 + is_punct(at(nodes, i + 1), "*")
        name = nodes[i].value if is_name(at(nodes, i)) else None
        i += name is not None
        while i < len(nodes) and not is_group(nodes[i], "("):  # type parameters
            i += 1
        j = _skip_type(nodes, i + 1, "{")
        if is_group(at(nodes, i), "(") and is_group(at(nodes, j), "{"):
            return Function(nodes[i], nodes[j].items, nodes[j].end, j + 1, name)
        return None
    if is_punct(at(nodes, i), "<"):
        while i < len(nodes) and not is_group(nodes[i], "("):
            i += 1
    if is_group(at(nodes, i), "(") or is_name(at(nodes, i)):
        j = _skip_type(nodes, i + 1, "=>") if is_group(nodes[i], "(") else i + 1
        if is_punct(at(nodes, j), "=>"):
            body, after = _arrow_body(nodes, j + 1)
            if body or is_group(at(nodes, j + 1), "{"):
                return Function(nodes[i], body, nodes[after - 1].end, after)
    return None


def class_at(nodes: list[Node], i: int) -> tuple[str | None, list[Node], Node, int] | None:
    """Name, base and body of the class at i."""
    if not is_name(at(nodes, i), "class"):
        return None
    j = i + 1
    name = None
    if is_name(at(nodes, j)) and nodes[j].value != "extends":
        name, j = nodes[j].value, j + 1
    base: list[Node] = []
    while j < len(nodes) and not is_group(nodes[j], "{"):
        base.append(nodes[j])
        j += 1
    return (name, base, nodes[j], j + 1) if j < len(nodes) else None


def is_component_base(base: list[Node]) -> bool:
    """extends Component, PureComponent, or a member of that name."""
    names = [n.value for n in base]
    if not names or names[0] != "extends":
        return False
    if len(names) > 3 and names[2] == "." and base[1].kind == "name":
        return names[3] in ("Component", "PureComponent") and base[3].kind == "name"
    return len(base) > 1 and base[1].kind == "name" and names[1] in ("Component", "PureComponent")


def props_of(params: Node | None) -> dict:
    """Of the first parameter: a name, or the keys and rests of an object pattern."""
    if params is None:
        return {"names": [], "spreads": 0}
    if params.kind == "name":
        return {"names": [params.value], "spreads": 0}
    first = at(params.items, 0)
    if is_name(first):
        return {"names": [first.value], "spreads": 0}
    if not is_group(first, "{"):
        return {"names": [], "spreads": 0}
    names, spreads, fresh = [], 0, True
    items = first.items
    for n in items:
        if is_punct(n, "..."):
            spreads, fresh = spreads + 1, False
        elif is_punct(n, ","):
            fresh = True
        elif fresh and n.kind in ("name", "string"):
            names.append(n.value)
            fresh = False
    return {"names": names, "spreads": spreads}


class Features:
    """What a walk over a component's nodes gathers, in order."""

    LISTS = ("hooks", "logic", "literals", "tags", "paths", "texts", "classes", "refs")

    def __init__(self, descend_calls: bool):
        self.descend_calls, self.returns_count = descend_calls, 0
        for k in self.LISTS:
            setattr(self, k, [])
        self.stack: list[str] = []

    def walk(self, nodes: list[Node], in_class: bool = False) -> None:
        i = 0
        while i < len(nodes):
            i = self.step(nodes, i, in_class)

    def step(self, nodes: list[Node], i: int, in_class: bool) -> int:
        n, after = nodes[i], at(nodes, i + 1)
        if n.kind == "name":
            if n.value in ("const", "let", "var") and is_name(after) and is_punct(at(nodes, i + 2), "=") and (f := function_at(nodes, i + 3)):
                if not is_name(at(nodes, i + 3), "function") or f.name is None:
                    self.logic.append(after.value)
                if f.name:
                    self.logic.append(f.name)
                self.walk(f.body)
                return f.after
            if n.value in ("function", "async") and (f := function_at(nodes, i)):
                if f.name:
                    self.logic.append(f.name)
                self.walk(f.body)
                return f.after
            if in_class and is_group(after, "(") and is_group(at(nodes, i + 2), "{"):
                self.walk(nodes[i + 2].items)
                return i + 3
            if c := class_at(nodes, i):
                self.walk(c[2].items, True)
                return c[3]
            call = is_group(after, "(") and n.value not in _BLOCKS and n.value not in _BEFORE_VALUE and n.value != "function"
            before = at(nodes, i - 1)
            if call and (is_punct(before, ".") or is_punct(before, "?.")):
                self.logic.append(n.value)
            elif call and re.match(r"use[A-Z0-9_$]|use$", n.value):
                self.hooks.append(n.value)
            return i + 1
        if n.kind in ("string", "number"):
            self.literals.append(n.value)
        elif n.kind == "template":
            self.walk(n.items)
        elif n.kind == "markup":
            self.element(n)
        elif n.kind == "group":
            if n.value == "(":
                if f := function_at(nodes, i):
                    self.walk(f.body)
                    return f.after
                if ends_value(nodes[:i]) and not self.descend_calls:
                    return i + 1
            elif n.value == "[" and not ends_value(nodes[:i]) and not self.descend_calls:
                return i + 1
            self.walk(n.items)
        return i + 1

    def element(self, n: Node) -> None:
        self.returns_count += bool(n.value)
        tag = "Unknown" if ":" in n.value else n.value.split(".")[-1]
        if n.value:
            self.tags.append(tag)
            self.stack.append(tag)
            self.paths.append(">".join(self.stack))
            if _PASCAL.match(n.value.split(".")[0]):
                self.refs.append(n.value.split(".")[0])
        for name, value in n.attributes:
            if name == "...":
                self.literals.append("spread")
                self.walk(value.items[1:])
            elif value is not None and value.kind == "string":
                if name == "className":
                    self.classes += value.value.split()
                self.literals += [value.value, value.value]
            elif value is not None and value.kind == "group":
                names = [x for x in value.items if x.kind == "name"]
                plain = all(x.kind == "name" or is_punct(x, ".") for x in value.items)
                if plain and names and _PASCAL.match(names[0].value):
                    self.refs.append(names[0].value)
                self.walk(value.items)
            elif value is not None:
                self.element(value)
        for child in n.items:
            if child.kind == "text":
                self.texts.append(child.value)
            elif child.kind == "markup":
                self.element(child)
            else:
                self.walk(child.items)
        if n.value:
            self.stack.pop()


def _found(nodes: list[Node], base: str) -> Iterator[tuple[str, int, int, Node | None, list[Node], bool, str | None]]:
    """Name, span, parameters, body, whether a class, and the function's own name, of each component, outer before inner."""
    i = 0
    while i < len(nodes):
        n = nodes[i]
        default = is_name(n, "default") and is_name(at(nodes, i - 1), "export")
        if default:
            f, c = function_at(nodes, i + 1), class_at(nodes, i + 1)
            if f:
                yield f.name or base, nodes[i + 1].start, f.end, f.params, f.body, False, f.name
                yield from _found(f.body, base)
                i = f.after
                continue
            if c and is_component_base(c[1]):
                yield c[0] or base, nodes[i + 1].start, c[2].end, None, c[2].items, True, None
                yield from _found(c[2].items, base)
                i = c[3]
                continue
        if n.kind == "name" and n.value in ("const", "let", "var") and is_name(at(nodes, i + 1)):
            j = _skip_type(nodes, i + 2, "=")
            f = function_at(nodes, j + 1) if is_punct(at(nodes, j), "=") else None
            if f:
                if _PASCAL.match(nodes[i + 1].value):
                    yield nodes[i + 1].value, nodes[i + 1].start, f.end, f.params, f.body, False, f.name or nodes[i + 1].value
                yield from _found(f.body, base)
                i = f.after
                continue
        if n.kind == "name" and n.value in ("function", "async") and (f := function_at(nodes, i)):
            if f.name and _PASCAL.match(f.name):
                yield f.name, n.start, f.end, f.params, f.body, False, f.name
            yield from _found(f.body, base)
            i = f.after
            continue
        if c := class_at(nodes, i):
            if c[0] and _PASCAL.match(c[0]) and is_component_base(c[1]):
                yield c[0], n.start, c[2].end, None, c[2].items, True, None
            yield from _found(c[2].items, base)
            i = c[3]
            continue
        if n.kind == "group":
            if not (n.value == "(" and ends_value(nodes[:i])):
                yield from _found(n.items, base)
        i += 1


def _style_imports(nodes: list[Node], path: str, extensions: tuple[str, ...]) -> list[str]:
    out = []
    for i, n in enumerate(nodes):
        if is_name(n, "import"):
            j = i + 1
            while j < len(nodes) and j < i + 12 and nodes[j].kind != "string" and not is_name(nodes[j], "import"):
                j += 1
            if j < len(nodes) and nodes[j].kind == "string" and nodes[j].value.endswith(extensions):
                name = nodes[j].value
                out.append(posixpath.normpath(posixpath.join(posixpath.dirname(path), name)) if name.startswith(".") else name)
    return out


def parse_source(path: str, source: str, allow_ignores: bool = True, extensions: tuple[str, ...] = STYLE_EXTENSIONS, descend_calls: bool = False) -> list[dict]:
    """The component records of one file, in order of appearance, outer before inner; raises Broken."""
    if allow_ignores and IGNORE_FILE in source:
        return []
    nodes = Scanner(source, posixpath.splitext(path)[1] in MARKUP).nodes()
    starts = [0] + [m.end() for m in re.finditer("\n", source)]
    rows = source.split("\n")
    imports = _style_imports(nodes, path, extensions)
    base = re.sub(r"\.\w+$", "", posixpath.basename(path))

    def place(offset: int) -> dict:
        line = bisect.bisect_right(starts, offset)
        return {"line": line, "column": offset - starts[line - 1]}

    out = []
    for name, start, end, params, body, is_class, own in _found(nodes, base):
        line = place(start)["line"]
        if allow_ignores and any(IGNORE_NEXT in x for x in rows[max(0, line - 3) : line - 1]):
            continue
        f = Features(descend_calls)
        if own:
            f.logic.append(own)
        f.walk(body, is_class)
        out.append(
            {"id": f"{path}#{name}", "name": name, "path": path, "source": source[start:end], "loc": {"start": place(start), "end": place(end)}, "props": props_of(params), "returns_count": f.returns_count, "style_imports": imports}
            | {k: getattr(f, k) for k in Features.LISTS}
        )
    return out


_LOC = "struct<start:struct<line:int,column:int>,end:struct<line:int,column:int>>"
SCHEMA = (
    f"id string, name string, path string, source string, loc {_LOC}, props struct<names:array<string>,spreads:int>, returns_count int, style_imports array<string>, "
    + ", ".join(f"{k} array<string>" for k in Features.LISTS)
    + ", ordinal int, error string"
)


def is_thin() -> Column:
    """The narrow wrapper mark: few lines, tags, literals and elements, but props."""
    return (
        (text.filled_line_count(F.col("source")) <= 12)
        & (F.size("tags") <= 2)
        & (F.size("props.names") + F.col("props.spreads") > 0)
        & (F.size("literals") <= 4)
        & (F.col("returns_count") <= 2)
    )


def parse_files(files: DataFrame, allow_ignores: bool = True, descend_calls: bool = False, errors: bool = False, extensions: tuple[str, ...] = STYLE_EXTENSIONS, strict: bool = False) -> DataFrame:
    """A row for each component of files (path, source), with wrapper; or, with errors, path and error of files that don't parse. Such
    files give no component; if strict they end the run with an error."""
    names = [c.split()[0] for c in ("id name path source loc props returns_count style_imports " + " ".join(Features.LISTS) + " ordinal error").split()]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, source in zip(batch.path, batch.source, strict=True):
                try:
                    out += [r | {"ordinal": i, "error": None} for i, r in enumerate(parse_source(path, source or "", allow_ignores, extensions, descend_calls))]
                except (Broken, RecursionError, IndexError, ValueError) as e:
                    if strict:
                        raise ValueError(f"{path}: {e}") from e
                    out.append({"path": path, "error": str(e) or type(e).__name__})
            yield pd.DataFrame(out, columns=names).astype(object).where(lambda t: t.notna(), None)

    rows = files.select("path", "source").mapInPandas(run, SCHEMA)
    if errors:
        return rows.where("error is not null").select("path", "error")
    return rows.where("error is null").drop("error").withColumn("wrapper", is_thin())
