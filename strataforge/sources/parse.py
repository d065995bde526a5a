"""Parse source files into structure: imports, exports, functions, classes, comments, complexity.

Python goes through its own syntax tree; the brace languages through the lexer and matched braces. One narrow pass
per file; nothing is shuffled.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.lexing import LANGUAGES, Lexed, lex
from strataforge.functions.rows import flat_map
from strataforge.schemas import FILE

_OPEN, _CLOSE = {"(", "[", "{", "TPLH"}, {")", "]", "}", "TPLT"}


def symbol_id(kind: str, path: str, name: str, start: int) -> str:
    return hashlib.sha256(f"{kind}:{path}:{name}:{start}".encode()).hexdigest()


def clean(comment: str) -> str:
    text = re.sub(r"\*/$", "", re.sub(r"^(?:/\*\*?|//[/!]?|#)", "", comment))
    return "\n".join(re.sub(r"^\s*(?:\* ?|///? ?)", "", line).rstrip() for line in text.split("\n")).strip()


class Structure:
    """Tokens of one file with matched braces, and what is drawn from them."""

    def __init__(self, language: str, path: str, content: str):
        self.language, self.path, self.content = language, path, content
        self.x: Lexed = lex(language, content)
        self.s, self.n = self.x.syms, len(self.x.syms)
        self.pair: dict[int, int] = {}
        self.depth: list[int] = []
        stack: list[int] = []
        for i, t in enumerate(self.s):
            if t in _CLOSE and stack:
                j = stack.pop()
                self.pair[i], self.pair[j] = j, i
            self.depth.append(len(stack))
            if t in _OPEN:
                stack.append(i)

    def word(self, i: int) -> str:
        return self.x.text[self.x.starts[i] : self.x.ends[i]] if 0 <= i < self.n else ""

    def text(self, i: int, j: int) -> str:
        return self.content[self.x.starts[i] : self.x.ends[j]] if i <= j < self.n else ""

    def line(self, i: int) -> int:
        at = self.x.starts[min(i, self.n - 1)]
        return self.content.count("\n", 0, at) + 1

    def skip(self, i: int) -> int:
        return self.pair[i] + 1 if self.s[i] in _OPEN and i in self.pair else i + 1

    def literal(self, i: int) -> str:
        return self.word(i)[1:-1]

    def comments(self) -> list[dict]:
        out = []
        for a, b in self.x.comments:
            raw = self.x.text[a:b].rstrip()
            first = self.content.count("\n", 0, a) + 1
            kind = "doc" if raw.startswith("/**") or raw.startswith("///") else "block" if raw.startswith("/*") else "line"
            out.append({"text": clean(raw), "type": kind, "startLine": first, "endLine": first + raw.count("\n")})
        return out

    def complexity(self, first: int = 0, last: int | None = None) -> int:
        last = self.n - 1 if last is None else last
        s, total = self.s, 1
        script = self.language in ("javascript", "typescript")
        decisions = {"if", "for", "while", "catch"} | ({"case", "&&", "||", "??"} if script else {"switch", "match", "foreach"} if self.language != "go" else set())
        dos: list[int] = []
        for i in range(first, last + 1):
            t = s[i]
            if t == "do" and self.language != "rust":
                total += 1
                dos.append(self.pair.get(i + 1, -1) + 1)
            elif t == "while" and i in dos:
                continue
            elif t in decisions:
                total += 1
            elif t == "?" and self.language not in ("go", "rust") and i + 1 <= last and s[i + 1] not in (":", ",", ")", ";", "=", ">", "]", "."):
                total += script or self.language in ("java", "csharp")
        return total

    def code_lines(self) -> int:
        if self.language in ("javascript", "typescript"):
            lines: set[int] = set()
            at, number = 0, 1
            for a, b in zip(self.x.starts, self.x.ends, strict=True):
                number += self.content.count("\n", at, a)
                at = a
                lines.update(range(number, number + self.content.count("\n", a, b) + 1))
            return len(lines)
        if self.language == "python":
            return sum(1 for line in self.content.split("\n") if line.strip() and not line.lstrip().startswith("#"))
        covered: set[int] = set()
        for c in self.comments():
            covered.update(range(c["startLine"], c["endLine"] + 1))
        return sum(1 for i, line in enumerate(self.content.split("\n"), 1) if line.strip() and i not in covered)

    # -- shared shapes ---------------------------------------------------------------------------
    def function(self, name: int, first: int, last: int, params: int, **flags) -> dict:
        inside = range(params + 1, self.pair.get(params, params))
        parameters, start = [], params + 1
        for i in inside:
            if self.s[i] == "," and self.depth[i] == self.depth[params] + 1:
                parameters.append(self.text(start, i - 1))
                start = i + 1
        if start <= self.pair.get(params, params) - 1:
            parameters.append(self.text(start, self.pair[params] - 1))
        return {
            "id": symbol_id("function", self.path, self.word(name), self.x.starts[name]), "name": self.word(name), "startLine": self.line(first), "endLine": self.line(last), "parameters": parameters, "returnType": flags.get("returns"),
            "isAsync": flags.get("is_async", False), "isExported": flags.get("exported", False), "isGenerator": flags.get("generator", False), "isArrow": flags.get("arrow", False),
            "complexity": self.complexity(first, last), "decorators": flags.get("decorators", []), "docComment": self.doc(first),
        }

    def klass(self, name: int, first: int, last: int, **f) -> dict:
        return {
            "id": symbol_id("class", self.path, self.word(name), self.x.starts[name]), "name": self.word(name), "startLine": self.line(first), "endLine": self.line(last), "methods": f.get("methods", []),
            "properties": f.get("properties", []), "decorators": f.get("decorators", []), "implements": f.get("implements", []), "extends": f.get("extends"), "isAbstract": f.get("abstract", False),
            "isExported": f.get("exported", False), "visibility": f.get("visibility", "public"),
        }

    def doc(self, first: int) -> str | None:
        after = self.x.ends[first - 1] if first else 0
        held = [self.x.text[a:b] for a, b in self.x.comments if after <= a < self.x.starts[first]]
        return clean(held[-1]) or None if held and held[-1].startswith(("/**", "///")) else None

    def members(self, at: int) -> tuple[list[str], list[str]]:
        """Names of methods and properties directly inside a class body that opens at ``at``."""
        methods, properties = [], []
        i, end = at + 1, self.pair.get(at, at)
        header = i
        while i < end:
            t = self.s[i]
            if t == "@" or (t == "[" and self.language == "csharp" and i == header):
                i = self.skip(i) if t == "[" else i + 2
                if t == "@" and i < end and self.s[i] == "(":
                    i = self.skip(i)
                header = i
            elif t == "(":
                name = i - 1
                if self.s[name] == ">":
                    while name > header and self.s[name] != "<":
                        name -= 1
                    name -= 1
                methods.append(self.word(name))
                i = self.skip(i)
                while i < end and self.s[i] not in ("{", ";") and not (i in self.x.breaks and self.language in ("javascript",)):
                    i = self.skip(i) if self.s[i] in ("(", "[") else i + 1
                i = header = self.skip(i) if i < end and self.s[i] == "{" else i + 1
            elif t in ("=", ";", "{") or (t == ":" and self.language == "typescript"):
                if i > header:
                    properties.append(self.word(i - 1) if self.s[i - 1] not in ("?", "!") else self.word(i - 2))
                while i < end and self.s[i] != ";" and not (t == "{" and i > header and self.s[i - 1] == "}") and not (i in self.x.breaks and self.language in ("javascript", "typescript") and i > header + 1 and self.s[i - 1] not in ("=", ",", "|")):
                    i = self.skip(i)
                if i < end and self.s[i] == ";":
                    i += 1
                header = i
            else:
                i += 1
        return methods, properties


def _script(p: Structure) -> tuple[list, list, list, list]:
    s, n = p.s, p.n
    imports, exports, functions, classes = [], [], [], []

    def specs(i: int) -> tuple[list[tuple[str, str | None, bool]], int]:
        out, end = [], p.pair.get(i, i)
        k = i + 1
        while k < end:
            only = s[k] == "type" and k + 1 < end and s[k + 1] not in (",", "as")
            k += only
            name, alias = p.word(k), None
            if k + 2 < end and s[k + 1] == "as":
                alias = p.word(k + 2)
                k += 2
            out.append((name, alias, only))
            k += 2
        return out, end

    spec = lambda name, alias=None, default=False, star=False: {"name": name, "alias": alias, "isDefault": default, "isNamespace": star}
    declared = set()
    for i in range(n):
        if s[i] == "import" and i + 2 < n and s[i + 1] == "(" and s[i + 2] == "STR":
            imports.append({"source": p.literal(i + 2), "specifiers": [], "isTypeOnly": False, "isDynamic": True})
        if p.depth[i]:
            continue
        if s[i] == "import" and i + 1 < n and s[i + 1] not in ("(", "."):
            k, only, held = i + 1, False, []
            if s[k] == "type" and s[k + 1] not in ("from", ","):
                only, k = True, k + 1
            while k < n and s[k] not in ("STR", ";"):
                if s[k] == "{":
                    found, k = specs(k)
                    held += [spec(a, b) for a, b, _ in found]
                elif s[k] == "*" and s[k + 1] == "as":
                    held.append(spec(p.word(k + 2), None, False, True))
                    k += 2
                elif s[k] not in (",", "from"):
                    held.append(spec(p.word(k), None, True))
                k += 1
            if k < n and s[k] == "STR":
                imports.append({"source": p.literal(k), "specifiers": held, "isTypeOnly": only, "isDynamic": False})
        elif s[i] == "export" and i + 1 < n:
            k = i + 1
            only = s[k] == "type" and s[k + 1] in ("{", "*")
            k += only
            if s[k] == "*":
                while k < n and s[k] != "STR":
                    k += 1
                exports.append({"name": "*", "type": "barrel", "isTypeOnly": only, "source": p.literal(k)})
            elif s[k] == "{":
                found, end = specs(k)
                source = p.literal(end + 2) if end + 2 < n and s[end + 1] == "from" else None
                exports += [{"name": b or a, "type": "re-export" if source else "named", "isTypeOnly": only or o, "source": source} for a, b, o in found]
            elif s[k] == "=":
                exports.append({"name": p.word(k + 1), "type": "namespace", "isTypeOnly": False, "source": None})
            elif s[k] == "default":
                if s[k + 1] not in ("function", "class", "async", "abstract"):
                    e = k + 1
                    while e < n and s[e] != ";" and not (e in p.x.breaks and e > k + 1):
                        e = p.skip(e)
                    exports.append({"name": p.text(k + 1, e - 1), "type": "default", "isTypeOnly": False, "source": None})
                exports.append({"name": "default", "type": "default", "isTypeOnly": False, "source": None})
            else:
                while s[k] in ("declare", "abstract", "async"):
                    k += 1
                kind, k = s[k], k + 1
                k += kind == "const" and s[k] == "enum"
                k += s[k] == "*"
                if kind in ("const", "let", "var") and s[k] not in ("{", "["):
                    while k < n:
                        declared.add(p.word(k))
                        exports.append({"name": p.word(k), "type": "named", "isTypeOnly": False, "source": None})
                        while k < n and s[k] not in (",", ";") and not (k in p.x.breaks and s[k] in ("export", "const", "function", "class", "import")):
                            k = p.skip(k)
                        if k < n and s[k] == ",":
                            k += 1
                            continue
                        break
                elif kind in ("function", "class", "enum", "interface", "type", "namespace"):
                    exports.append({"name": p.word(k), "type": "named", "isTypeOnly": kind in ("interface", "type"), "source": None})
        elif s[i] == "function" and i + 1 < n:
            star = s[i + 1] == "*"
            k = i + 1 + star
            o = k + 1
            while o < n and s[o] != "(":
                o += 1
            body = p.pair.get(o, n) + 1
            while body < n and s[body] not in ("{", ";"):
                body += 1
            if k < n and s[k] != "(" and body < n and s[body] == "{":
                first = i
                while first and s[first - 1] in ("async", "export", "default", "declare"):
                    first -= 1
                mods = s[first:i]
                functions.append(p.function(k, first, p.pair.get(body, n - 1), o, is_async="async" in mods, exported="export" in mods, generator=star))
        elif s[i] in ("const", "let", "var") and i + 2 < n and s[i + 1] not in ("{", "["):
            k = i + 2
            while k < n and s[k] not in ("=", ";"):
                k = p.skip(k)
            k += 1
            asynchronous = k < n and s[k] == "async"
            k += asynchronous
            if k >= n:
                continue
            arrow = s[k] == "(" and p.pair.get(k) is not None
            named = s[k] == "function"
            o = k
            if named:
                while o < n and s[o] != "(":
                    o += 1
            end = p.pair.get(o, n) + 1
            while arrow and end < n and s[end] not in ("=>", ";", "=") and end - o < 400:
                end = p.skip(end)
            if (arrow and end < n and s[end] == "=>") or named:
                body = end + 1 if arrow else end
                last = p.pair.get(body) if body < n and s[body] == "{" else None
                if last is None:
                    last = body
                    while last + 1 < n and s[last + 1] != ";" and (last + 1) not in p.x.breaks:
                        last = p.pair.get(last + 1, last + 1)
                first = i - 1 if i and s[i - 1] == "export" else i
                functions.append(p.function(i + 1, first, min(last, n - 1), o, is_async=asynchronous, exported=first < i, arrow=arrow))
        elif s[i] == "class" and i + 1 < n and s[i + 1] != "{":
            k, ext, impl, mode = i + 2, None, [], None
            while k < n and s[k] != "{":
                if s[k] in ("extends", "implements"):
                    mode = s[k]
                elif mode == "extends" and ext is None:
                    ext = p.word(k)
                elif mode == "implements" and s[k] == "ID" and s[k - 1] in ("implements", ","):
                    impl.append(p.word(k))
                k = p.skip(k) if s[k] == "(" else k + 1
            first = i
            while first and s[first - 1] in ("abstract", "export", "default", "declare"):
                first -= 1
            mods = s[first:i]
            methods, properties = p.members(k) if k < n else ([], [])
            classes.append(p.klass(i + 1, first, p.pair.get(k, n - 1), methods=methods, properties=properties, extends=ext, implements=impl, abstract="abstract" in mods, exported="export" in mods))
    functions.sort(key=lambda f: f["startLine"])
    return imports, exports, functions, classes


def _plain_import(source: str, specifiers: list | None = None) -> dict:
    return {"source": source, "specifiers": specifiers or [], "isTypeOnly": False, "isDynamic": False}


def _named(name: str) -> dict:
    return {"name": name, "type": "named", "isTypeOnly": False, "source": None}


def _go(p: Structure) -> tuple[list, list, list, list]:
    s, n = p.s, p.n
    imports, exports, functions, classes, methods = [], [], [], {}, {}
    for i in range(n):
        if p.depth[i]:
            continue
        if s[i] == "import":
            end = p.pair.get(i + 1, i + 3) if i + 1 < n and s[i + 1] == "(" else i + 3
            imports += [_plain_import(p.literal(k)) for k in range(i, min(end, n)) if s[k] == "STR"]
        elif s[i] == "type" and i + 3 < n and s[i + 2] == "struct":
            classes[p.word(i + 1)] = p.klass(i + 1, i, p.pair.get(i + 3, i + 3), properties=[p.word(k) for k in range(i + 4, p.pair.get(i + 3, i + 3)) if s[k] == "ID" and s[k - 1] in ("{", ";")], exported=p.word(i + 1)[:1].isupper())
        elif s[i] == "func":
            k, owner = i + 1, None
            if k < n and s[k] == "(":
                owner = next((p.word(j) for j in range(p.pair.get(k, k) - 1, k, -1) if s[j] == "ID"), None)
                k = p.pair.get(k, k) + 1
            o = k + 1
            while o < n and s[o] not in ("(", ";"):
                o = p.skip(o) if s[o] == "[" else o + 1
            body = p.pair.get(o, n) + 1
            while body < n and s[body] not in ("{", ";"):
                body = p.skip(body)
            last = p.pair.get(body, body) if body < n and s[body] == "{" else min(body, n - 1)
            if owner:
                methods.setdefault(owner, []).append(p.word(k))
            elif k < n:
                functions.append(p.function(k, i, min(last, n - 1), o, exported=p.word(k)[:1].isupper()))
    for name, held in methods.items():
        if name in classes:
            classes[name]["methods"] = held
    exports = [_named(x["name"]) for x in [*classes.values(), *functions] if x["name"][:1].isupper()]
    return imports, exports, functions, list(classes.values())


def _typed(p: Structure) -> tuple[list, list, list, list]:
    s, n, java = p.s, p.n, p.language == "java"
    imports, classes = [], []
    i = 0
    while i < n:
        if s[i] in ("import", "using") and not p.depth[i]:
            k = i + 1
            while k < n and s[k] in ("static", "global"):
                k += 1
            e = k
            while e < n and s[e] != ";":
                e += 1
            if e > k and "=" not in s[k:e] and s[k] != "(":
                imports.append(_plain_import("".join(p.word(j) for j in range(k, e))))
            i = e
        elif s[i] in ("class", "interface", "record", "struct") and i + 1 < n and s[i + 1] == "ID" and (not i or s[i - 1] != "."):
            k, ext, impl, mode = i + 2, None, [], None
            while k < n and s[k] not in ("{", ";"):
                if s[k] in ("extends", "implements", ":"):
                    mode = s[k]
                elif s[k] in ("ID", "object") and s[k - 1] in ("extends", "implements", ":", ","):
                    if mode == "extends" or (mode == ":" and ext is None):
                        ext = p.word(k)
                    else:
                        impl.append(p.word(k))
                k = p.skip(k) if s[k] in ("(", "[") else k + 1
            first = i
            while first and (s[first - 1] in ("public", "private", "protected", "internal", "static", "final", "abstract", "sealed", "partial", "readonly")):
                first -= 1
            mods = s[first:i]
            methods, properties = p.members(k) if k < n and s[k] == "{" else ([], [])
            vis = next((m for m in mods if m in ("public", "private", "protected")), "public")
            classes.append(p.klass(i + 1, first, p.pair.get(k, min(k, n - 1)), methods=methods, properties=properties, extends=ext, implements=impl, abstract="abstract" in mods, exported="public" in mods, visibility=vis))
        i += 1
    return imports, [_named(c["name"]) for c in classes if c["isExported"]], [], classes


def _rust(p: Structure) -> tuple[list, list, list, list]:
    s, n = p.s, p.n
    imports, functions, classes = [], [], {}
    inside: list[tuple[int, int]] = []
    for i in range(n):
        public = i and (s[i - 1] == "pub" or (s[i - 1] == ")" and s[p.pair.get(i - 1, i) - 1] == "pub"))
        if s[i] == "use" and not p.depth[i]:
            e = i + 1
            while e < n and s[e] != ";":
                e += 1
            imports.append(_plain_import("".join(p.word(j) for j in range(i + 1, e))))
        elif s[i] == "struct" and not p.depth[i] and i + 1 < n:
            k = i + 2
            while k < n and s[k] not in ("{", ";", "("):
                k += 1
            props = [p.word(j) for j in range(k + 1, p.pair.get(k, k)) if s[j] == "ID" and j + 1 < n and s[j + 1] == ":" and p.depth[j] == 1] if k < n and s[k] == "{" else []
            classes[p.word(i + 1)] = p.klass(i + 1, i, p.pair.get(k, min(k, n - 1)), properties=props, exported=bool(public))
        elif s[i] == "impl" and not p.depth[i]:
            k = i + 1
            names = []
            while k < n and s[k] != "{":
                if s[k] == "for":
                    names = []
                elif s[k] == "ID" and s[k - 1] in ("impl", "for", ">"):
                    names.append(p.word(k))
                k += 1
            end = p.pair.get(k, n)
            inside.append((k, end))
            if names and names[0] in classes:
                classes[names[0]]["methods"] = [p.word(j + 1) for j in range(k, min(end, n - 1)) if s[j] == "fn" and p.depth[j] == 1]
        elif s[i] == "fn" and not any(a < i < b for a, b in inside) and i + 2 < n:
            o = i + 2
            while o < n and s[o] not in ("(", ";"):
                o += 1
            body = p.pair.get(o, n) + 1
            while body < n and s[body] not in ("{", ";"):
                body += 1
            if body < n and s[body] == "{":
                functions.append(p.function(i + 1, i, p.pair.get(body, n - 1), o, exported=bool(public), is_async=bool(i and "async" in s[max(0, i - 2) : i])))
    return imports, [_named(x["name"]) for x in [*classes.values(), *functions] if x["isExported"]], functions, list(classes.values())


def _python_complexity(node: ast.AST) -> int:
    total = 0
    for x in ast.walk(node):
        if isinstance(x, (ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.Match, ast.match_case, ast.IfExp, ast.If)):
            total += 1
        if isinstance(x, ast.If) and len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If) and x.orelse[0].col_offset == x.col_offset:
            total -= 1
    return total


def _python(p: Structure, tree: ast.Module) -> tuple[list, list, list, list]:
    imports, exports, functions, classes = [], [], [], []
    public = lambda name: not name.startswith("_")
    offsets = [0]
    for line in p.content.split("\n"):
        offsets.append(offsets[-1] + len(line) + 1)
    sees = lambda name: "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") else "public"
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [_plain_import(a.name, [{"name": a.name, "alias": a.asname, "isDefault": False, "isNamespace": True}]) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports.append(_plain_import("." * node.level + (node.module or ""), [{"name": a.name, "alias": a.asname, "isDefault": False, "isNamespace": False} for a in node.names]))
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            functions.append({
                "id": symbol_id("function", p.path, node.name, offsets[node.lineno - 1] + node.col_offset), "name": node.name, "startLine": node.lineno, "endLine": node.end_lineno, "parameters": [ast.unparse(a) for a in [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]],
                "returnType": ast.unparse(node.returns) if node.returns else None, "isAsync": isinstance(node, ast.AsyncFunctionDef), "isExported": public(node.name), "isGenerator": any(isinstance(x, (ast.Yield, ast.YieldFrom)) for x in ast.walk(node)), "isArrow": False,
                "complexity": 1 + _python_complexity(node), "decorators": [ast.unparse(x) for x in node.decorator_list], "docComment": ast.get_docstring(node),
            })
        elif isinstance(node, ast.ClassDef):
            bases = [ast.unparse(b) for b in node.bases]
            classes.append({
                "id": symbol_id("class", p.path, node.name, offsets[node.lineno - 1] + node.col_offset), "name": node.name, "startLine": node.lineno, "endLine": node.end_lineno, "methods": [x.name for x in node.body if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef))],
                "properties": [t.id for x in node.body if isinstance(x, (ast.Assign, ast.AnnAssign)) for t in (x.targets if isinstance(x, ast.Assign) else [x.target]) if isinstance(t, ast.Name)], "decorators": [ast.unparse(x) for x in node.decorator_list],
                "implements": bases[1:], "extends": bases[0] if bases else None, "isAbstract": any(b.endswith("ABC") for b in bases), "isExported": public(node.name), "visibility": sees(node.name),
            })
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            exports += [_named(t.id) for t in (node.targets if isinstance(node, ast.Assign) else [node.target]) if isinstance(t, ast.Name) and public(t.id)]
    exports = [_named(x["name"]) for x in [*functions, *classes] if x["isExported"]] + exports
    return imports, exports, functions, classes


def parse_file(path: str, language: str | None, content: str | None) -> dict:
    """One FILE row. An unknown language or Python that doesn't parse gives an ``error``; nothing is raised."""
    text = content or ""
    digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
    row = {"path": path, "id": hashlib.sha256(f"{path}:{digest}".encode()).hexdigest(), "language": language, "hash": digest, "size": len(text.encode("utf-8", "surrogatepass")), "linesOfCode": 0, "complexity": 1, "imports": [], "exports": [], "functions": [], "classes": [], "comments": [], "error": None}
    if language not in LANGUAGES:
        return row | {"error": f"unsupported language {language}"}
    p = Structure(language, path, text)
    row |= {"linesOfCode": p.code_lines(), "comments": p.comments()}
    try:
        if language == "python":
            tree = ast.parse(text.lstrip("﻿"))
            found, row["complexity"] = _python(p, tree), 1 + _python_complexity(tree)
        else:
            found = {"go": _go, "rust": _rust, "java": _typed, "csharp": _typed}.get(language, _script)(p)
            row["complexity"] = p.complexity() if p.n else 1
    except (SyntaxError, ValueError, RecursionError, IndexError, KeyError) as error:
        return row | {"error": f"{type(error).__name__}: {error}"[:200]}
    row["imports"], row["exports"], row["functions"], row["classes"] = found
    return row




_NAMES = ("path", "id", "language", "hash", "size", "linesOfCode", "complexity", "imports", "exports", "functions", "classes", "comments", "error")


def parse(files: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """FILE rows, after ``keys`` (such as a repository), of (keys..., path, language, content); one row per input row, null content counts as empty."""
    n = len(keys)

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        for row in rows:
            parsed = parse_file(*row[n:])
            yield (*row[:n], *(parsed[c] for c in _NAMES))

    types = {f.name: f.dataType.simpleString() for f in files.schema}
    return flat_map(files, [*keys, "path", "language", "content"], each, ", ".join([*(f"{k} {types[k]}" for k in keys), FILE]))


def parse_incremental(now: DataFrame, previous: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows of ``previous`` whose (keys..., path, language, hash) still holds are reused; only the others are parsed."""
    hashed = now.withColumn("hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    key = [F.col(f"n.{k}") == F.col(f"p.{k}") for k in (*keys, "path", "hash")] + [F.col("n.language").eqNullSafe(F.col("p.language"))]
    known = previous.select(*keys, "path", "language", "hash")
    fresh = hashed.alias("n").join(known.alias("p"), key, "left_anti")
    kept = previous.alias("p").join(hashed.select(*keys, "path", "language", "hash").alias("n"), key, "left_semi")
    return kept.unionByName(parse(fresh, keys))


def coverage(scanned: DataFrame, parsed: DataFrame) -> DataFrame:
    """(scanned, parsed, skipped, failed) in one row: files with a language, parsed well, of unsupported languages, with errors."""
    joined = scanned.select("path").join(parsed.select("path", "error", "language"), "path", "left")
    bad = F.col("error").startswith("unsupported")
    return joined.agg(F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("language").isNotNull() & F.col("error").isNull()).alias("parsed"), F.count_if(bad).alias("skipped"), F.count_if(F.col("error").isNotNull() & ~bad).alias("failed"))
