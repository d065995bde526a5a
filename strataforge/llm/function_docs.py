"""Functions paired with their documentation.

A lexer that knows strings and comments gives tokens; braces are matched over tokens, so that braces in
literals don't count. A documentation comment belongs to a function if only decorators, annotations,
attributes and modifiers stand between them.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.grammars import check
from strataforge.functions.lexing import LANGUAGES, Lexed, lex
from strataforge.functions.rows import flat_map

MIN_WORDS = 4
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}", "TPLH": "TPLT"}, frozenset([")", "]", "}", "TPLT"])


@dataclass
class Found:
    name: str
    name_at: int  # offset of the name
    first: int  # index of the item's first token, decorators included
    last: int  # index of the body's last token
    documentation: str = ""


def _pairs(x: Lexed) -> dict[int, int]:
    """Index of the closing token for each opening one, and the reverse."""
    stack, out = [], {}
    for i, s in enumerate(x.syms):
        if s in _OPEN:
            stack.append(i)
        elif s in _CLOSE and stack:
            j = stack.pop()
            out[i], out[j] = j, i
    return out


# -- where functions are ------------------------------------------------------------------------------
_SCRIPT_MODS = frozenset("export default async declare const let var public private protected static readonly abstract override get set accessor *".split())


def _back_over_decorators(x: Lexed, pair: dict[int, int], i: int) -> int:
    """``i`` is the first token of an item; the first of its decorators ``@name(...)`` before it."""
    s = x.syms
    while i > 1:
        j = i - 1
        if s[j] == ")" and j in pair:
            j = pair[j] - 1
        k = j
        while k >= 2 and s[k - 1] == ".":
            k -= 2
        if k >= 1 and s[k - 1] == "@" and x.ends[k - 1] == x.starts[k]:
            i = k - 1
        else:
            break
    return i


def _script(x: Lexed) -> Iterator[Found]:
    s, pair, n = x.syms, _pairs(x), len(x.syms)
    word = lambda i: x.text[x.starts[i] : x.ends[i]]

    def signature(i: int) -> int:
        """Index after parameters and return type of a signature that begins at ``i``; -1 if there is none."""
        if i < n and s[i] == "<":
            depth = 0
            while i < n:
                depth += (s[i] == "<") - (s[i] == ">")
                i += 1
                if not depth:
                    break
        if i >= n or s[i] != "(" or i not in pair:
            return -1
        i = pair[i] + 1
        if i < n and s[i] == ":":
            i, fresh = i + 1, True
            while i < n:
                if s[i] == "{" and not fresh or s[i] in ("=>", ";", ")", "}", ","):
                    break
                if s[i] in _OPEN and i in pair:
                    i, fresh = pair[i] + 1, False
                    if i < n and s[i] == "=>" and s[i - 1] == ")":  # a function type
                        i, fresh = i + 1, True
                    continue
                fresh = s[i] in ("|", "&", "<", "keyof", "readonly", "is", "extends", "?", ":")
                i += 1
        return i

    def statement_end(i: int) -> int:
        while i < n and s[i] not in (";", ")", "]", "}", ","):
            i = pair[i] + 1 if s[i] in _OPEN and i in pair else i + 1
        return i - 1

    for i in range(n):
        if s[i] == "function":
            k = i + 2 if i + 1 < n and s[i + 1] == "*" else i + 1
            if k < n and s[k] != "(" and (end := signature(k + 1)) >= 0 and end < n and s[end] == "{" and end in pair:
                j = i
                while j and s[j - 1] in ("async", "export", "default", "declare"):
                    j -= 1
                yield Found(word(k), x.starts[k], _back_over_decorators(x, pair, j), pair[end])
        elif s[i] in ("const", "let", "var") and i + 2 < n and s[i + 1] not in ("{", "["):
            k = i + 2
            if s[k] == ":":
                while k < n and s[k] not in ("=", ";"):
                    k = pair[k] + 1 if s[k] in _OPEN and k in pair else k + 1
            if k >= n or s[k] != "=":
                continue
            k += 1
            if k < n and s[k] == "async" and not (k + 1 < n and s[k + 1] == "=>"):
                k += 1
            last = -1
            if k < n and s[k] == "function":
                m = k + 1
                while m < n and s[m] not in ("(", "<"):
                    m += 1
                end = signature(m)
                last = pair.get(end, -1) if 0 <= end < n and s[end] == "{" else -1
            elif k + 1 < n and (s[k + 1] == "=>" or (end := signature(k)) >= 0 and end < n and s[end] == "=>"):
                end = k + 2 if s[k + 1] == "=>" else end + 1
                last = pair.get(end, -1) if end < n and s[end] == "{" else statement_end(end)
            if last > 0:
                j = i
                while j and s[j - 1] == "export":
                    j -= 1
                yield Found(word(i + 1), x.starts[i + 1], j, last)
        elif s[i] == "class" and not (i and s[i - 1] == "."):
            k = i + 1
            while k < n and s[k] != "{":
                k = pair[k] + 1 if s[k] == "(" and k in pair else k + 1
            if k < n and k in pair:
                yield from _script_members(x, pair, k, signature, word)


def _script_members(x: Lexed, pair: dict[int, int], at: int, signature, word) -> Iterator[Found]:
    s, end, i = x.syms, pair[at], at + 1
    first = i
    while i < end:
        if s[i] == ";":
            i += 1
            first = i
        elif s[i] == "@":
            i += 2
            while i < end and s[i] == ".":
                i += 2
            if i < end and s[i] == "(" and i in pair:
                i = pair[i] + 1
        elif s[i] in _SCRIPT_MODS and i + 1 < end and s[i + 1] not in ("(", "=", ":", ";", "<", "?", "!"):
            i += 1
        elif i + 1 < end and s[i + 1] in ("(", "<") and s[i] not in _OPEN and s[i] not in _CLOSE:
            body = signature(i + 1)
            if 0 <= body < end and s[body] == "{" and body in pair:
                yield Found(word(i), x.starts[i], first, pair[body])
                i = first = pair[body] + 1
            else:
                i = max(body, i + 1)
                first = i
        elif s[i] == "{" and i in pair:  # a static block
            i = first = pair[i] + 1
        else:  # a field: up to its end
            i += 1
            while i < end and s[i] != ";" and not (i in x.breaks and s[i - 1] not in ("=", "=>", ",", "(", ":", "|", "&", "?", ".", "+")):
                i = pair[i] + 1 if s[i] in _OPEN and i in pair else i + 1
            first = i


def _typed_members(x: Lexed, language: str) -> Iterator[Found]:
    """Java and C#: a member's header runs from the last member's end to a brace, an arrow or a semicolon."""
    s, pair, n = x.syms, _pairs(x), len(x.syms)
    types = frozenset("class interface enum record struct namespace".split())

    def body(i: int, end: int) -> Iterator[Found]:
        first, round_, equals, heading = i, -1, False, False
        while i < end:
            t = s[i]
            if t == "(" and i in pair:
                if not equals and round_ < 0 and not heading and s[i - 1] == "ID" or s[i - 1] in ("record", "value", "get", "set", "var", "when", "where", "add", "remove", "init") and round_ < 0 and not equals:
                    k = i - 1
                    while k >= first + 2 and s[k - 1] == ".":
                        k -= 2
                    if not (k > first and s[k - 1] == "@"):
                        round_ = i
                i = pair[i] + 1
            elif t == "[" and i in pair:
                i = pair[i] + 1
            elif t == "=" and round_ < 0:
                equals = True
                i += 1
            elif t in types and not equals and round_ < 0 and i + 1 < end and s[i + 1] not in ("(", "=", ";", ",", "."):
                heading = True
                i += 1
            elif t == "{" and i in pair:
                if heading:
                    yield from body(i + 1, pair[i])
                elif round_ >= 0 and not equals:
                    yield Found(x.text[x.starts[round_ - 1] : x.ends[round_ - 1]], x.starts[round_ - 1], first, pair[i])
                i = pair[i] + 1
                if equals and i < end and s[i] not in (";", ","):
                    equals = False
                if not equals:
                    first, round_, heading = i, -1, False
            elif t == "=>" and not equals:
                k = i
                while k < end and s[k] != ";":
                    k = pair[k] + 1 if s[k] in _OPEN and k in pair else k + 1
                if round_ >= 0:
                    yield Found(x.text[x.starts[round_ - 1] : x.ends[round_ - 1]], x.starts[round_ - 1], first, min(k, n - 1))
                i = first = k + 1
                round_, equals, heading = -1, False, False
            elif t == ";" or t == "," and language == "java" and round_ >= 0 and i + 1 < end and s[i + 1] in ("ID", "@") and s[i - 1] == ")" and not heading:
                i += 1
                first, round_, equals, heading = i, -1, False, False
            else:
                i += 1

    yield from body(0, n)


def _go(x: Lexed) -> Iterator[Found]:
    s, pair, n = x.syms, _pairs(x), len(x.syms)
    for i in range(n):
        if s[i] != "func" or (i and s[i - 1] != ";"):
            continue
        k = i + 1
        if k < n and s[k] == "(" and k in pair:
            k = pair[k] + 1
        if k + 1 >= n or s[k] not in ("ID", "_") or s[k + 1] not in ("(", "["):
            continue
        m = k + 1
        while m < n and s[m] != ";" and not (s[m] == "{" and s[m - 1] not in ("interface", "struct")):
            m = pair[m] + 1 if s[m] in _OPEN and m in pair else m + 1
        if m < n and s[m] == "{" and m in pair:
            yield Found(x.text[x.starts[k] : x.ends[k]], x.starts[k], i, pair[m])


def _rust(x: Lexed) -> Iterator[Found]:
    s, pair, n = x.syms, _pairs(x), len(x.syms)
    for i in range(n - 2):
        if s[i] != "fn" or s[i + 1] in ("(", "<"):
            continue
        m = i + 2
        while m < n and s[m] not in (";", "{"):
            m = pair[m] + 1 if s[m] in ("(", "[") and m in pair else m + 1
        if m >= n or s[m] != "{" or m not in pair:
            continue
        j = i
        while j:
            if s[j - 1] in ("pub", "const", "async", "unsafe", "extern", "default", "crate") or s[j - 1] == "STR" and j > 1 and s[j - 2] == "extern":
                j -= 1
            elif s[j - 1] == ")" and (j - 1) in pair and pair[j - 1] and s[pair[j - 1] - 1] == "pub":
                j = pair[j - 1] - 1
            elif s[j - 1] == "]" and (j - 1) in pair and pair[j - 1] and s[pair[j - 1] - 1] == "#":
                j = pair[j - 1] - 1
            else:
                break
        yield Found(x.text[x.starts[i + 1] : x.ends[i + 1]], x.starts[i + 1], j, pair[m])


def _python(x: Lexed) -> Iterator[Found]:
    s, pair, n = x.syms, _pairs(x), len(x.syms)
    for i in range(n - 2):
        if s[i] != "def":
            continue
        m = i + 2
        while m < n and s[m] not in (":", "NEWLINE"):
            m = pair[m] + 1 if s[m] in _OPEN and m in pair else m + 1
        if m + 1 >= n or s[m] != ":":
            continue
        block = s[m + 1] == "NEWLINE"
        k = m + 3 if block and m + 2 < n and s[m + 2] == "INDENT" else m + 1
        text = ""
        if k < n and s[k] == "STR":
            e = k
            while e + 1 < n and s[e + 1] == "STR":
                e += 1
            if e + 1 >= n or s[e + 1] in ("NEWLINE", ";"):
                text = literal_text("python", "".join(f"{x.text[a:b]} " for a, b in zip(x.starts[k : e + 1], x.ends[k : e + 1], strict=True)))
        depth, last = 0, m + 1
        while last < n:
            depth += (s[last] == "INDENT") - (s[last] == "DEDENT")
            if depth == 0 and s[last] in ("NEWLINE", "DEDENT") and not (block and last == m + 1):
                break
            last += 1
        first = i - 1 if i and s[i - 1] == "async" else i
        while first > 1 and s[first - 1] == "NEWLINE":
            j = first - 2
            while j >= 0 and s[j] not in ("NEWLINE", "INDENT", "DEDENT"):
                j = pair[j] - 1 if s[j] in _CLOSE and j in pair else j - 1
            if j + 1 < n and s[j + 1] == "@":
                first = j + 1
            else:
                break
        yield Found(x.text[x.starts[i + 1] : x.ends[i + 1]], x.starts[i + 1], first, min(last, n - 1), text)


_FINDERS = {
    "javascript": _script, "typescript": _script, "python": _python, "go": _go, "rust": _rust,
    "java": lambda x: _typed_members(x, "java"), "csharp": lambda x: _typed_members(x, "csharp"),
}

_PREFIX = re.compile(r"(?i)^([rubft]*)(\"\"\"|'''|\"|')")


def literal_text(language: str, literal: str) -> str:
    """The text that a literal stands for; its inside as written where it can't be read."""
    if language == "python":
        m = _PREFIX.match(literal)
        if m and ("f" in m.group(1).lower() or "b" in m.group(1).lower() or "t" in m.group(1).lower()):
            return ""
        try:
            value = ast.literal_eval(literal.strip())
        except (ValueError, SyntaxError):
            return literal
        return value if isinstance(value, str) else ""
    return literal


# -- which comment documents them ---------------------------------------------------------------------
def _comment_before(x: Lexed, language: str, found: Found, name_token: int) -> str:
    """The documentation comment between the token before the item and the function's name."""
    after = x.ends[found.first - 1] if found.first else 0
    held = [c for c in x.comments if after <= c[0] < found.name_at]
    if not held:
        return ""
    spaces = [(x.starts[i], x.ends[i]) for i in range(found.first, name_token + 1)]
    marks = [(a, b, True) for a, b in held] + [(a, b, False) for a, b in spaces]
    marks.sort()
    lines: list[tuple[int, int]] = []
    for k in range(len(marks) - 1, -1, -1):  # the nearest comment, then its neighbours of the same form
        a, b, is_comment = marks[k]
        if not is_comment:
            if lines:
                break
            continue
        nxt = lines[-1][0] if lines else marks[k + 1][0]
        gap = x.text[b:nxt]
        head = x.text[:a].rpartition("\n")[2]
        if gap.count("\n") > 1 or (head.strip() and not head.strip().startswith("}")):
            break
        if lines and not (x.text.startswith("//", a) and x.text.startswith("//", lines[-1][0])):
            break
        lines.append((a, b))
    lines.reverse()
    if not lines:
        return ""
    texts = [x.text[a:b].rstrip() for a, b in lines]
    if texts[0].startswith("/*"):
        ok = language == "go" or texts[0].startswith("/**") and not texts[0].startswith("/***") and len(texts[0]) > 4
        return texts[-1] if ok and len(texts) == 1 else ""
    if language == "go":
        return "\n".join(t for t in texts if not re.match(r"//[a-z]+:\S", t))
    if language in ("rust", "csharp"):
        doc = []
        for t in reversed(texts):
            if not t.startswith("///") or t.startswith("////"):
                break
            doc.append(t)
        return "\n".join(reversed(doc))
    return ""


def clean_comment(comment: str) -> str:
    """Comment text without its marks."""
    if comment.startswith("/*"):
        inner = re.sub(r"\*+/$", "", re.sub(r"^/\*+", "", comment))
        return "\n".join(re.sub(r"^\s*\*? ?", "", line).rstrip() for line in inner.split("\n")).strip()
    return "\n".join(re.sub(r"^\s*//[/!]? ?", "", line).rstrip() for line in comment.split("\n")).strip()


_KEEP_TAGS = "description|desc|summary|remarks|brief"
_SECTIONS = re.compile(
    r"(?i)^\s*(?:#+\s*)?(?:args|arguments|parameters|params|returns?|return value|raises?|yields?|throws|exceptions?|panics?|errors?|safety|examples?|other parameters|keyword args|notes?|see also)\s*:?\s*$"
)
_FIELD = re.compile(r"^\s*(?::(?:param|parameter|arg|argument|key|keyword|type|raises?|except|exception|return|returns|rtype|yields?|var|ivar)\b[^:]*:|[@\\](?!(?:" + _KEEP_TAGS + r")\b)[a-zA-Z]+)")
_XML_GONE = re.compile(r"<(param|typeparam|returns|exception|value|permission|example|seealso)\b[^>]*?(?:/>|>[\s\S]*?</\1\s*>)")
_MARKUP = re.compile(r"<[^<>\n]*>|\{@\w+|\[`?|`?\]\([^)]*\)|https?://\S+|[@\\](?:" + _KEEP_TAGS + r")\b")
_TODO = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b(?:\([^)]*\))?", re.I)
_HAN = re.compile(r"[぀-ヿ㐀-鿿豈-﫿가-힯]")
_WORDS = re.compile(r"[^\W_]+(?:['’][^\W\d_]+)?")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+|\d+")


def remaining_words(documentation: str, name: str) -> int:
    """Words left without tags, sections, markup, to-do marks and the words of the function's own name.
    Two characters of a script without spaces count as a word."""
    kept, skipping, indent = [], False, 0
    for line in _XML_GONE.sub(" ", documentation).split("\n"):
        if _FIELD.match(line):
            skipping, indent = True, -1
            continue
        if _SECTIONS.match(line):
            skipping, indent = True, len(line) - len(line.lstrip())
            if line.lstrip().startswith("#"):
                indent = -2
            continue
        if skipping:
            blank = not line.strip()
            if indent == -2:
                if not line.lstrip().startswith("#"):
                    continue
                skipping = False
            elif indent == -1:
                if not blank:
                    continue
                skipping = False
                continue
            elif blank or len(line) - len(line.lstrip()) > indent or re.fullmatch(r"\s*-{3,}\s*", line):
                continue
            else:
                skipping = False
        kept.append(line)
    text = _TODO.sub(" ", _MARKUP.sub(" ", "\n".join(kept)))
    own = {p.lower() for p in _PARTS.findall(name)} | {name.lower()}
    han = len(_HAN.findall(text))
    words = [w for w in _WORDS.findall(_HAN.sub(" ", text)) if w.lower() not in own]
    return len(words) + han // 2


def documented_functions(language: str, content: str | None, min_words: int = MIN_WORDS) -> Iterator[tuple[str, int, str, str]]:
    """(name, line of the name, documentation, code) of a valid text's functions with non-trivial documentation."""
    x = lex(language, content or "")
    if check(language, x).fault:
        return
    index = {a: i for i, a in enumerate(x.starts)} if language != "python" else {}
    for f in _FINDERS[language](x):
        doc = f.documentation if language == "python" else clean_comment(_comment_before(x, language, f, index[f.name_at]))
        if doc and remaining_words(doc, f.name) >= min_words:
            yield f.name, content.count("\n", 0, f.name_at) + 1, doc.strip(), content[x.starts[f.first] : x.ends[f.last]]


def _each(rows: Iterator[tuple]) -> Iterator[tuple]:
    for file_id, language, content in rows:
        for name, line, doc, code in documented_functions(language, content):
            yield file_id, language, name, line, doc, code


def function_pairs(files: DataFrame) -> DataFrame:
    """Code–description pairs: file_id, language, function_name, line_no, description, code.

    Each input row is read on its own, so a repeated row repeats its pairs. Invalid files, null, empty
    or comment-only content and unknown languages give none. Narrow: no shuffle.
    """
    source = files.filter(F.col("language").isin(*LANGUAGES) & (F.length("content") > 0))
    return flat_map(source, ["file_id", "language", "content"], _each, "file_id bigint, language string, function_name string, line_no int, description string, code string")


def found(files: DataFrame) -> DataFrame:
    return function_pairs(files).select("file_id", "function_name", "line_no").distinct()
