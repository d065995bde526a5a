"""String- and comment-aware lexers for seven languages.

One compiled expression per language walks the text; a small state machine adds what a regular
expression can't hold: nested comments, template literals, regular-expression literals, Python's
indentation and Go's implied semicolons. ``>`` is always a token of its own, so that type arguments close.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

BOM = "﻿"

#: Reserved words of each language.
RESERVED = {
    "javascript": """break case catch class const continue debugger default delete do else export extends false finally for function if
        import in instanceof new null return super switch this throw true try typeof var void while with enum await""",
    "python": """False None True and as assert async await break class continue def del elif else except finally for from global if
        import in is lambda nonlocal not or pass raise return try while with yield""",
    "java": """abstract assert boolean break byte case catch char class const continue default do double else enum extends final
        finally float for goto if implements import instanceof int interface long native new package private protected public return
        short static strictfp super switch synchronized this throw throws transient try void volatile while true false null""",
    "go": """break case chan const continue default defer else fallthrough for func go goto if import interface map package range
        return select struct switch type var""",
    "rust": """as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self
        Self static struct super trait true type unsafe use where while async await dyn""",
    "csharp": """abstract as base bool break byte case catch char checked class const continue decimal default delegate do double else
        enum event explicit extern false finally fixed float for foreach goto if implicit in int interface internal is lock long
        namespace new null object operator out override params private protected public readonly ref return sbyte sealed short sizeof
        stackalloc static string struct switch this throw true try typeof uint ulong unchecked unsafe ushort using virtual void
        volatile while""",
}
RESERVED["typescript"] = RESERVED["javascript"]
#: Words that are keywords in some places only.
CONTEXTUAL = {
    "javascript": "async of get set static let yield from as type interface namespace declare abstract readonly public private protected keyof infer is module implements override accessor satisfies unique asserts global using target meta",
    "python": "match case type _",
    "java": "record sealed permits non var yield when",
    "go": "",
    "rust": "union auto macro_rules default",
    "csharp": "record var get set init add remove where when async await yield partial required file global and or not with nameof select from let orderby into join on equals by group ascending descending scoped value",
}
CONTEXTUAL["typescript"] = CONTEXTUAL["javascript"]
KEYWORDS = {lang: frozenset(RESERVED[lang].split()) | frozenset(CONTEXTUAL[lang].split()) for lang in RESERVED}

_DQ, _SQ = r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'"
_NUM = r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.\d[\d_]*|\.(?![\w.]))?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?"
_ID = r"(?!\d)\w++"
_SLASHES = r"(?P<nl>\n)|(?P<com>//[^\n]*|/\*[\s\S]*?\*/)"


def _ops(words: str) -> str:
    return "|".join(re.escape(w) for w in sorted(words.split(), key=len, reverse=True))


def _build(*parts: str) -> re.Pattern:
    """White space before a token belongs to its match, which halves the number of matches."""
    return re.compile(r"(?:[^\S\n]*(?:" + "|".join(parts) + r"|(?P<end>\Z)))")


_TRIPLE = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""'
_PATTERNS = {
    "javascript": _build(
        r"(?P<id>\#?(?!\d)[\w$]++)", _SLASHES, rf"(?P<str>{_DQ}|{_SQ})", rf"(?P<num>(?:{_NUM})n?)(?![\w$])",
        "(?P<op>" + _ops("=> === !== == != <= << ... ?. ?? ??= && || &&= ||= ++ -- += -= *= /= %= **= ** &= |= ^= <<= { } ( ) [ ] ; , < > . ? : = + - * / % & | ^ ! ~ @ `") + ")",
    ),
    "java": _build(
        r"(?P<id>(?!\d)[\w$]++)", _SLASHES, rf"(?P<str>{_TRIPLE}|(?!\"\"\"){_DQ})", r"(?P<chr>'(?:[^'\\\n]|\\[^\n]{1,5}?)')", rf"(?P<num>(?:{_NUM})[lLfFdD]?)(?![\w$])",
        "(?P<op>" + _ops("-> :: ... == != <= << <<= && || ++ -- += -= *= /= %= &= |= ^= { } ( ) [ ] ; , < > . ? : = + - * / % & | ^ ! ~ @") + ")",
    ),
    "go": _build(
        rf"(?P<id>{_ID})", _SLASHES, rf"(?P<str>`[^`]*`|{_DQ})", r"(?P<chr>'(?:[^'\\\n]|\\[^\n]{1,10}?)')", rf"(?P<num>(?:{_NUM})i?)(?!\w)",
        "(?P<op>" + _ops(":= ... == != <= << <<= && || ++ -- += -= *= /= %= &= |= ^= &^ &^= <- { } ( ) [ ] ; , < > . : = + - * / % & | ^ ! ~") + ")",
    ),
    "rust": _build(
        rf"(?P<id>(?:r\#)?{_ID}(?![\"']|#+\"))", r"(?P<nl>\n)|(?P<com>//[^\n]*)|(?P<nest>/\*)", r'(?P<str>(?:b|c)?r(?P<h>#*)"[\s\S]*?"(?P=h)|[bc]?"(?:[^"\\]|\\[\s\S])*")', r"(?P<chr>b?'(?:[^'\\\n]|\\u\{[^}']*\}|\\x[0-9a-fA-F]{2}|\\[^\n])')", rf"(?P<life>'{_ID})",
        rf"(?P<num>(?:{_NUM})(?:_?(?:[iu](?:8|16|32|64|128|size)|f32|f64))?)(?!\w)",
        "(?P<op>" + _ops("=> -> :: ..= ... .. == != <= << <<= && || += -= *= /= %= &= |= ^= { } ( ) [ ] ; , < > . : = + - * / % & | ^ ! ? @ # $") + ")",
    ),
    "csharp": _build(
        rf"(?P<id>@?{_ID})", _SLASHES, r"(?P<pre>\#[ \t]*(?:if|else|elif|endif|region|endregion|pragma|nullable|define|undef|error|warning|line)\b[^\n]*)",
        r'(?P<str>\$*"""[\s\S]*?"""|(?:\$@|@\$)"(?:[^"]|"")*"|@"(?:[^"]|"")*"|\$"(?:[^"\\\n{}]|\\.|\{\{|\}\}|\{(?:[^{}"\n]|"(?:[^"\\\n]|\\.)*"|\{[^{}\n]*\})*\})*"|' + _DQ + ")(?:u8)?",
        r"(?P<chr>'(?:[^'\\\n]|\\[^\n]{1,9}?)')", rf"(?P<num>(?:{_NUM})[uUlLfFdDmM]{{0,2}})(?!\w)",
        "(?P<op>" + _ops("=> == != <= << <<= ?? ??= ?. && || ++ -- += -= *= /= %= &= |= ^= -> :: .. { } ( ) [ ] ; , < > . ? : = + - * / % & | ^ ! ~") + ")",
    ),
    "python": _build(
        rf"(?P<id>{_ID}(?![\"']))|(?P<nl>\n)|(?P<join>\\[^\S\n]?\n)|(?P<com>\#[^\n]*)",
        r"""(?P<str>(?:[rR][bBfFtT]?|[bB][rR]?|[uU]|[fFtT][rR]?)?(?:"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}|(?!"{3})"(?:[^"\\\n]|\\[\s\S])*"|(?!'{3})'(?:[^'\\\n]|\\[\s\S])*'))""",
        rf"(?P<num>(?:{_NUM}|\d[\d_]*\.)[jJ]?)(?!\w)",
        "(?P<op>" + _ops("-> := ... == != <= >= << >> <<= >>= // //= ** **= += -= *= /= %= &= |= ^= @= { } ( ) [ ] ; , < > . : = + - * / % & | ^ ~ @ !") + ")",
    ),
}
_PATTERNS["typescript"] = _PATTERNS["javascript"]
LANGUAGES = tuple(_PATTERNS)

_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_NEST = re.compile(r"/\*|\*/")
#: After one of these a slash divides.
_VALUE_END = frozenset([")", "]", "}", "ID", "NUM", "STR", "TPL", "TPLT", "REGEX", "this", "super", "null", "true", "false"])
_GO_END = frozenset(["ID", "NUM", "STR", "CHR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])


@dataclass
class Lexed:
    """Tokens in parallel lists. ``syms`` holds a keyword's or operator's own text, else a class such as ID."""

    text: str
    syms: list[str] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)
    breaks: set[int] = field(default_factory=set)  # indexes of tokens that a line break precedes
    comments: list[tuple[int, int]] = field(default_factory=list)
    strings: list[tuple[int, int]] = field(default_factory=list)

    @property
    def broken(self) -> bool:
        return bool(self.syms) and self.syms[-1] == "ERR"


def lex(language: str, text: str) -> Lexed:
    """Tokens of ``text``. A lexeme that the language doesn't have ends them with the symbol ERR."""
    if "\r" in text:
        text = _same_length_newlines(text)
    out = Lexed(text)
    at = 1 if text.startswith(BOM) else 0
    if text.startswith("#!", at) and language != "rust":
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        out.comments.append((at, end))
        at = end
    if language == "python":
        _lex_python(out, at)
    else:
        _lex_braces(out, at, language)
    return out


def _same_length_newlines(text: str) -> str:
    """Line ends become line feeds without moving any offset."""
    return re.sub(r"\r(?!\n)", "\n", text).replace("\r\n", " \n")


def _lex_braces(out: Lexed, at: int, language: str) -> None:
    text, n = out.text, len(out.text)
    match, words = _PATTERNS[language].match, KEYWORDS[language]
    syms, starts, ends, breaks = out.syms, out.starts, out.ends, out.breaks
    js, go = language in ("javascript", "typescript"), language == "go"
    holes: list[int] = []  # brace depth inside each open template hole
    fresh = False
    add_sym, add_start, add_end = syms.append, starts.append, ends.append
    while at < n:
        m = match(text, at)
        if m is None:
            at = n - len(text[at:].lstrip())
            syms.append("ERR"), starts.append(at), ends.append(at + 1)
            return
        kind = m.lastgroup
        at, end = m.span(kind)
        if kind == "nl":
            if go and syms and syms[-1] in _GO_END and not fresh:
                syms.append(";"), starts.append(at), ends.append(at)
            fresh, at = True, end
            continue
        if kind == "com" or kind == "pre":
            out.comments.append((at, end))
            if "\n" in m[kind]:
                if go and syms and syms[-1] in _GO_END and not fresh:
                    syms.append(";"), starts.append(at), ends.append(at)
                fresh = True
            at = end
            continue
        if kind == "nest":
            depth, end = 1, at + 2
            while depth and (k := _NEST.search(text, end)):
                depth += 1 if k.group() == "/*" else -1
                end = k.end()
            if depth:
                syms.append("ERR"), starts.append(at), ends.append(n)
                return
            out.comments.append((at, end))
            at = end
            continue
        if kind == "id":
            word = m[kind]
            sym = word if word in words else "ID"
        elif kind == "op":
            sym = m[kind]
            if js:
                if sym[0] == "/" and (not syms or syms[-1] not in _VALUE_END and not (syms[-1] in words and syms[-1] in CONTEXTUAL["javascript"].split())):
                    k = _REGEX.match(text, at)
                    if k:
                        sym, end = "REGEX", k.end()
                elif sym == "`" or (sym == "}" and holes and holes[-1] == 0):
                    k = _TEMPLATE.match(text, at + 1)
                    if k is None:
                        syms.append("ERR"), starts.append(at), ends.append(n)
                        return
                    end, opens = k.end(), k.group(1) != "`"
                    if sym == "`":
                        sym = "TPLH" if opens else "TPL"
                        if opens:
                            holes.append(0)
                    else:
                        sym = "TPLM" if opens else "TPLT"
                        if not opens:
                            holes.pop()
                    out.strings.append((at, end))
                elif holes and sym == "{":
                    holes[-1] += 1
                elif holes and sym == "}":
                    holes[-1] -= 1
            if sym == "/" and text.startswith("/*", at):  # a comment that nothing ends
                sym = "ERR"
        elif kind == "num":
            sym = "NUM"
        elif kind == "str":
            sym = "STR"
            out.strings.append((at, end))
        elif kind == "chr":
            sym = "CHR"
        elif kind == "end":
            break
        else:
            sym = "LIFE"
        if fresh:
            breaks.add(len(syms))
            fresh = False
        add_sym(sym)
        add_start(at)
        add_end(end)
        if sym == "ERR":
            return
        at = end
    if holes:
        return
    if go and syms and syms[-1] in _GO_END:
        syms.append(";"), starts.append(n), ends.append(n)


def _lex_python(out: Lexed, at: int) -> None:
    text, n = out.text, len(out.text)
    match, words = _PATTERNS["python"].match, KEYWORDS["python"]
    syms, starts, ends = out.syms, out.starts, out.ends
    levels, depth, line_start = [0], 0, True
    while at < n:
        m = match(text, at)
        if m is None:
            syms.append("ERR"), starts.append(at), ends.append(at + 1)
            return
        kind = m.lastgroup
        at, end = m.span(kind)
        if kind == "end":
            break
        if kind == "join":
            at = end
            continue
        if kind == "com":
            out.comments.append((at, end))
            at = end
            continue
        if kind == "nl":
            if not depth and not line_start:
                syms.append("NEWLINE"), starts.append(at), ends.append(end)
                line_start = True
            at = end
            continue
        if line_start:
            line_start = False
            lead = text[text.rfind("\n", 0, at) + 1 : at].lstrip(BOM)
            width = 0
            for c in lead:
                width = (width // 8 + 1) * 8 if c == "\t" else 0 if c == "\f" else width + 1
            if width > levels[-1]:
                levels.append(width)
                syms.append("INDENT"), starts.append(at), ends.append(at)
            while width < levels[-1]:
                levels.pop()
                syms.append("DEDENT"), starts.append(at), ends.append(at)
            if width != levels[-1]:
                syms.append("ERR"), starts.append(at), ends.append(end)
                return
        if kind == "id":
            word = m[kind]
            sym = word if word in words else "ID"
        elif kind == "op":
            sym = m[kind]
            if sym in "([{":
                depth += 1
            elif sym in ")]}":
                depth = max(0, depth - 1)
        elif kind == "num":
            sym = "NUM"
        else:
            sym = "STR"
            out.strings.append((at, end))
        syms.append(sym), starts.append(at), ends.append(end)
        at = end
    if not line_start:
        syms.append("NEWLINE"), starts.append(n), ends.append(n)
    for _ in levels[1:]:
        syms.append("DEDENT"), starts.append(n), ends.append(n)
