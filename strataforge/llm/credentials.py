"""Credentials embedded in source code and configuration, found and masked.

1. Every file is read for candidate literals: values under credential names, passwords and signatures in URLs, connection
   strings and headers, passwords stated in comments, and all literals with a token's structure, whatever their name.
2. The literals are indexed corpus-wide: a value in many repositories is a placeholder; a structure (a token prefix, or
   characters and length) that credential names mostly go with is a provider's, so rare values of it are confirmed under neutral names too.
3. Every file is read again with an automaton over the confirmed values, in the text and in literals joined by code, so that
   a secret is also found where nothing around it tells.

Values of fewer than MIN_LENGTH characters are no secrets except in URLs (3), connection strings and decoded headers (6). No length is too long.
"""

from __future__ import annotations

import base64
import binascii
import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from math import log2

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.rows import flat_map
from strataforge.runtime import cut

#: A value in more repositories than MAX_OWNERS and this share of all is a placeholder; one that looks random may be in a larger share.
MAX_OWNERS, MAX_OWNER_SHARE, MAX_OWNER_SHARE_RANDOM = 4, 0.05, 0.2
#: A token prefix is a provider's if this many different values under credential names bear it, as does this share of all its values.
MIN_PREFIX_VALUES, MIN_PREFIX_SHARE = 2, 0.2
#: The same for a structure without a prefix (characters and length).
MIN_SHAPE_VALUES, MIN_SHAPE_SHARE = 20, 0.8
#: Bytes of confirmed values in one automaton; more values are matched in further passes over the files.
BLOCK_BYTES = 8 << 20
MIN_LENGTH = 8

#: Words that name a credential, and words after them that name something about it.
_NAMES = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|passwd|secrets?|tokens?|api ?keys?|(?:signing|access|private|auth|deploy|encryption|service|master|account|license|shared|storage|ssh) key|credentials?|bearer|client key)\b")
_ABOUT = frozenset(
    """label hint title rule rules scope kind header column ref reference name names id ids field type types path file prefix suffix count length
    size limit min max policy regex pattern expiry ttl expires text shape format digest checksum hash fingerprint sum commit sha etag uuid trace
    placeholder description message error url uri endpoint host selector public provider manager store""".split()
)
#: Token structures of public services.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9_])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[\w\-]{20,}|xox[abprs]-[A-Za-z0-9\-]{10,}|"
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w\-]{35}|ya29\.[\w\-]{20,}|npm_[A-Za-z0-9]{30,}|pypi-[\w\-]{40,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|"
    r"eyJ[\w\-]{8,}\.eyJ[\w\-]{6,}\.[\w\-]{16,})(?![A-Za-z0-9_])"
)
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_PEM_LINE = re.compile(r"(?>(?:\\[nr]|[\s\"',;|\\]|(?<=[ \"'])\+(?=[\s\"']))*)([A-Za-z0-9+/]{16,}={0,2}|[A-Za-z0-9+/]+={1,2})")
_PEM_BODY = re.compile(r"(?:[\s\"'+,;|\\]|\\[nr]|(?:Proc-Type|DEK-Info|Version|Comment): ?[^\n\\]*)*([A-Za-z0-9+/=]{24,})")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_URL_PASSWORD = re.compile(r"[a-zA-Z][\w+.\-]*://[^\s:/@\"'`<>]*:([^\s@/\"'`<>]{3,})@[\w\[]")
_URL_SIGNATURE = re.compile(r"[?&](?:sig|signature|token|access_token|auth|api_?key|key|secret|client_secret|password|x-amz-signature|sv_sig)=([A-Za-z0-9%+/=_\-.~]{12,})", re.I)
_PREFIXED = re.compile(r"(?<![A-Za-z0-9_.\-])([a-z]{2,8}(?:[_\-][a-z]{2,8})?[_\-.])([A-Za-z0-9]{16,})(?![\w])")
_LITERAL = r"(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)"
_HINT = re.compile(r"(?i)pass|pwd|secret|token|key|cred|bearer")
_AROUND = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
_ASSIGNED = re.compile(r"([A-Za-z_][\w.\-]*)[\"'`]?\s?\]?\s*(?::\s*[&\w<>\[\]'?. ]{1,24}=|:=|=>|={1,3}|:|\(|,)\s*(?:[rbu]|concat!\s*\()?" + _LITERAL)
_MORE = re.compile(r"\s*[+,]?\s*\\?\s*" + _LITERAL)
_SEAM = re.compile(r"([\"'`])\s*\+\s*[rbu]?([\"'`])")
_CONCAT = re.compile(r"concat!\s*\(([^()]*)\)")
_PLUS = re.compile(r"\s*\+\s*" + _LITERAL)
_CALL = re.compile(r"(?:login|log_in|signin|sign_in|connect|authenticate|credentials|basic_?auth)\w*\(([^()\n]*)\)", re.I)
_IN_CALL = re.compile(_LITERAL)
_SETTING = re.compile(r"^[ \t]*(?:export[ \t]+|-[ \t]+)?[\"']?([A-Za-z_][\w.\-]*)[\"']?[ \t]*[:=][ \t]*(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s\"'#][^\n\r]*?))[ \t]*,?[ \t]*\r?$", re.M)
_LOOSE = re.compile(r"(?:[ \t]*[:=][ \t]*|[ \t]+)(?:(?:Bearer|Basic)\s+)?([^\s\"'`<>(){},;]{8,})")
_PHRASE = re.compile(r"(?:[A-Za-z][\w\-]* ){0,2}[A-Za-z][\w\-]*$")
_STRUCTURED = re.compile(r"(?<=[\"'`])[A-Za-z0-9+/=_\-.~]{16,}(?=[\"'`])")
_PARAMETER = re.compile(r"(?i)(?<=[;\"'`])\s*(?:password|pwd|account ?key|shared ?access ?key|access ?key|api ?key|client ?secret|secret|token)\s*=\s*([^;\"'`\s]{6,})(?=[;\"'`])")
_BASIC = re.compile(r"\b[Bb]asic\s+([A-Za-z0-9+/]{8,}={0,2})(?![A-Za-z0-9+/=])")
_STATED = re.compile(
    r"(?i)\b(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|signing) key|credentials?)(?: (?:on|for|of|at|to|in) [\w.\-@:/]+)? (?:is|was) +([^\s\"'`<>]{8,})"
    r"|\b(?:log ?in|sign ?in|credentials?|creds|account|user)\b:? +[\w.@\-]+ +/ +([^\s\"'`<>]{8,})"
)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

_PLACEHOLDER = re.compile(
    r"(?i)(.)\1*|<.*>|\{\{.*\}\}|\$\{.*|\$\(.*|\$[A-Z_][A-Z0-9_]*|%\w+%|#\{.*|.*(?:your[_\-]|change[_\-]?me|replace[_\-]?me|set[_\-]?me|fill[_\-]?me|placeholder|example|dummy|sample|redacted|x{6,}|\*{3,}|\.{3,}|todo|foobar).*|"
    r"(?:env|vault|file|secret|secrets|ssm|arn|op|kms|ref|keyring|config|param|gcp|aws|azure|sealed|sops)[:.].*|process\.env.*|os\.(?:environ|getenv).*|sha\d+[\-:].*|data:.*|ssh-(?:rsa|ed25519|dss) .*|https?://.*|/.*|\.{1,2}/.*"
)
_UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}")


def entropy(s: str) -> float:
    return -sum(c / len(s) * log2(c / len(s)) for c in Counter(s).values()) if s else 0.0


def named(name: str) -> bool:
    """Whether a name is a credential's. Words after the credential word may say that it's something about one."""
    words = [w.lower() for w in _SPLIT.findall(name)]
    joined = " ".join(words).replace("pass word", "password").replace("pass phrase", "passphrase")
    m = None
    for m in _NAMES.finditer(joined):
        pass
    if m is None or (m.start() and joined[m.start() - 1] != " "):
        return False
    return not any(w in _ABOUT for w in joined[m.end() :].split()) and "public" not in words


def strength(value: str) -> int:
    """0: no secret's value; 1: may be a chosen password; 2: looks random."""
    n = len(value)
    if n < MIN_LENGTH or _PLACEHOLDER.fullmatch(value) or _UUID.fullmatch(value) or any(c.isspace() for c in value):
        return 0
    digits, upper, lower = (sum(map(f, value)) for f in (str.isdigit, str.isupper, str.islower))
    if upper + lower == 0 or not value.isascii():
        return 0
    kinds = [("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s") for c in value]
    turns = sum(a != b for a, b in zip(kinds, kinds[1:]))
    hexed = re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value)
    if n >= 16 and digits and (entropy(value) >= (3.0 if hexed else 3.4)) and turns >= n / 6:
        return 2
    if not digits:
        return 2 if n >= 16 and upper and lower and turns >= n / 3 else 0
    if re.search(r"[()\[\]{}]|::|->", value) and n < 40 and re.search(r"\w\(|\[\w+=", value):
        return 0
    return 1 if upper + (n - digits - upper - lower) > 0 or turns >= 4 else 0


def _random_tail(tail: str) -> bool:
    return strength(tail) == 2 and any(c.isdigit() for c in tail) and (any(c.isupper() for c in tail) and any(c.islower() for c in tail) or len(tail) >= 24)


def chosen(value: str) -> bool:
    """Whether a value that stands where only a password can is one: no placeholder and no plain word."""
    if strength(value):
        return True
    if len(value) < 6 or _PLACEHOLDER.fullmatch(value) or not value.isascii() or any(c.isspace() for c in value):
        return False
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) >= 3 and len(_SPLIT.findall(value)) >= 3


def _basic(text: str) -> bool:
    """Whether a header's value is a name and a password."""
    try:
        name, colon, password = base64.b64decode(text, validate=True).decode("ascii").partition(":")
    except (binascii.Error, UnicodeDecodeError):
        return False
    return bool(colon and name.isprintable() and chosen(password))


def shape(value: str) -> str | None:
    """Characters and length of a value that has letters of both cases and digits; None for the shapes of checksums."""
    if len(value) > 256 or not (any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value)):
        return None
    if value.endswith("=") and len(value) in (24, 28, 44, 64, 88):
        return None
    return "".join(sorted({c for c in value if not c.isalnum()})) + str(len(value))


def private_keys(content: str) -> Iterator[tuple[int, int]]:
    """(start, end) of private keys with a body, from the BEGIN mark to the END mark, however far it is; a key without one
    ends with its last base64 line."""
    marks = list(_PEM.finditer(content))
    for m, after in zip(marks, [*marks[1:], None]):
        body = _PEM_BODY.match(content, m.end())
        if body:
            end = _PEM_END.search(content, m.end(), after.start() if after else len(content))
            at = body.end()
            while not end and (line := _PEM_LINE.match(content, at)):
                at = line.end()
            yield m.start(), end.start() if end else at


def candidates(content: str, settings: bool) -> Iterator[tuple[int, int, str, str, int]]:
    """(start, end, value, kind, strength) of possible credentials. ``settings`` is for files without a language.

    Kinds: ``known`` and ``url`` stand for themselves unless shared; ``named`` has a credential's name;
    ``prefixed`` (its strength is the prefix's length) waits for its prefix, ``shaped`` for its shape.
    """
    for m in _KNOWN.finditer(content):
        yield m.start(), m.end(), m.group(), "known", 2
    for m in _URL_PASSWORD.finditer(content):
        if not _PLACEHOLDER.fullmatch(m[1]) and not _NAMES.fullmatch(m[1].lower()):
            yield m.start(1), m.end(1), m[1], "url", 2
    for m in _URL_SIGNATURE.finditer(content):
        if strength(m[1]) == 2:
            yield m.start(1), m.end(1), m[1], "url", 2
    for m in _PREFIXED.finditer(content):
        if _random_tail(m[2]):
            yield m.start(), m.end(), m.group(), "prefixed", len(m[1])
    for m in _STRUCTURED.finditer(content):
        if strength(m.group()) == 2 and shape(m.group()):
            yield m.start(), m.end(), m.group(), "shaped", 2
    for m in _PARAMETER.finditer(content):
        if chosen(m[1]):
            yield m.start(1), m.end(1), m[1], "named", 1
    for m in _BASIC.finditer(content):
        if _basic(m[1]):
            yield m.start(1), m.end(1), m[1], "named", 2
    for m in _STATED.finditer(content):
        value = (m[1] or m[2]).rstrip(",;)")
        if value := value if strength(value) else "":
            yield m.start(m.lastindex), m.start(m.lastindex) + len(value), value, "named", 1
    if settings:
        for m in _SETTING.finditer(content):
            if named(m[1]):
                g = m.lastindex
                yield from _judged(m.start(g), m.end(g), m[g])
    done = -1
    for hint in _HINT.finditer(content):
        i, j = hint.start(), hint.end()
        if i < done:
            continue
        while i and content[i - 1] in _AROUND:
            i -= 1
        while j < len(content) and content[j] in _AROUND:
            j += 1
        done = j
        m = _ASSIGNED.match(content, i)
        if m and named(m[1]):
            g = m.lastindex
            value, end = m[g], m.end(g)
            more = _MORE if "concat!" in m.group() else _PLUS
            at = m.end()
            while k := more.match(content, at):
                value, end, at = value + k[k.lastindex], k.end(k.lastindex), k.end()
            yield from _judged(m.start(g), end, value)
        elif not m and (m := _LOOSE.match(content, j)):
            value = m[1] if settings else m[1].rstrip(".:!?")
            if strength(value) == 2 and (phrase := _PHRASE.search(content, max(0, i - 40), j)) and named(phrase.group()):
                yield m.start(1), m.start(1) + len(value), value, "named", 2
    for m in _CALL.finditer(content):
        parts = [(k.start(k.lastindex) + m.start(1), k.end(k.lastindex) + m.start(1), k[k.lastindex]) for k in _IN_CALL.finditer(m[1])]
        if len(parts) > 1:
            yield from _judged(*parts[-1])


def _judged(start: int, end: int, value: str) -> Iterator[tuple[int, int, str, str, int]]:
    s = strength(value)
    if s:
        yield start, end, value, "named", s


def _each(rows: Iterator[tuple]) -> Iterator[tuple]:
    for repo_id, language, content in rows:
        # a value put together from several literals is indexed whole, like one written whole elsewhere
        for value, kind, s in {(value, kind, s) for _, _, value, kind, s in candidates(content, language is None)}:
            yield repo_id, value, kind, value[:s] if kind == "prefixed" else None, shape(value) if kind in ("shaped", "named") else None, 2 if kind == "prefixed" else s


def _index(files: DataFrame) -> DataFrame:
    """Candidate values with owner counts: one row per value and whether it's named, known, prefixed or shaped.

    Two-level aggregation: (value, repository) folds map-side, so a placeholder in a third of all files is never gathered.
    """
    source = files.filter(F.length("content") > 0)
    found = flat_map(source, ["repo_id", "language", "content"], _each, "repo_id bigint, value string, kind string, prefix string, shape string, strength int")
    kinds = [F.max((F.col("kind") == "named").cast("int")).alias("named"), F.max(F.col("kind").isin("known", "url").cast("int")).alias("known")]
    each = found.groupBy("value", "repo_id").agg(*kinds, *[F.max(c).alias(c) for c in ("prefix", "shape", "strength")])
    return each.groupBy("value").agg(F.count(F.lit(1)).alias("owners"), *[F.max(c).alias(c) for c in ("named", "known", "prefix", "shape", "strength")])


def _mined(rare: DataFrame, key: str, values: int, share: float) -> DataFrame:
    """Structures that values under credential names go with."""
    counts = rare.filter(F.col(key).isNotNull()).groupBy(key).agg(F.sum("named").alias("n"), (F.sum("named") / F.count(F.lit(1))).alias("share"))
    return counts.filter((F.col("n") >= values) & (F.col("share") >= share)).select(key, F.lit(1).alias(f"_{key}"))


def confirmed(files: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Distinct secret values of the corpus (private keys stand for themselves and aren't among them)."""
    index = cut(_index(files))
    repositories = files.agg(F.count_distinct("repo_id")).first()[0]
    bound = F.when(F.col("strength") == 2, max(max_owners, int(MAX_OWNER_SHARE_RANDOM * repositories))).otherwise(max(max_owners, int(MAX_OWNER_SHARE * repositories)))
    rare = index.filter(F.col("owners") <= bound)
    told = rare.join(_mined(rare, "prefix", MIN_PREFIX_VALUES, MIN_PREFIX_SHARE), "prefix", "left").join(_mined(rare, "shape", MIN_SHAPE_VALUES, MIN_SHAPE_SHARE), "shape", "left")
    return told.filter((F.col("named") == 1) | (F.col("known") == 1) | F.col("_prefix").isNotNull() | F.col("_shape").isNotNull()).select("value")


def _chains(content: str) -> Iterator[list[tuple[int, int]]]:
    """(start, end) of the literals that code joins into one text."""
    held: list[tuple[int, int]] = []
    for m in _SEAM.finditer(content):
        start, end = content.rfind(m[1], content.rfind("\n", 0, m.start()) + 1, m.start()) + 1, content.find(m[2], m.end())
        if not start or end < 0:
            continue
        if held and held[-1][1] == m.start():
            held.append((m.end(), end))
            continue
        if held:
            yield held
        held = [(start, m.start()), (m.end(), end)]
    if held:
        yield held
    if "concat!" in content:
        for m in _CONCAT.finditer(content):
            yield [(k.start(k.lastindex) + m.start(1), k.end(k.lastindex) + m.start(1)) for k in _IN_CALL.finditer(m[1])]


class Scanner:
    """Spans of confirmed secrets and private keys in a text."""

    def __init__(self, values: Iterable[str]):
        import ahocorasick

        self.values = frozenset(values)
        self.automaton = ahocorasick.Automaton()
        for v in self.values:
            self.automaton.add_word(v, len(v))
        if self.values:
            self.automaton.make_automaton()

    def _hits(self, text: str) -> Iterator[tuple[int, int]]:
        n = len(text)
        for last, length in self.automaton.iter(text):
            a, b = last + 1 - length, last + 1
            if (a == 0 or not (text[a - 1].isalnum() and text[a].isalnum())) and (b == n or not (text[b].isalnum() and text[b - 1].isalnum())):
                yield a, b

    def spans(self, content: str, keys: bool = True) -> list[tuple[int, int]]:
        """Merged, in order. ``keys``: private keys too."""
        held = []
        if self.values:
            held += self._hits(content)
            for chain in _chains(content):
                starts, joined = [0], ""
                for a, b in chain:
                    joined += content[a:b]
                    starts.append(len(joined))
                for a, b in self._hits(joined):
                    first = next(i for i in range(len(chain)) if starts[i + 1] > a)
                    last = next(i for i in range(len(chain)) if starts[i + 1] >= b)
                    held.append((chain[first][0] + a - starts[first], chain[last][0] + b - starts[last]))
        if keys:
            held += private_keys(content)
        return merged(held)


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that overlap united."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_MASKED = re.compile(r"[^\s\"'`\\]")
_JOINED = re.compile(r"\\[nrt]|[\"'`]\s*[+,]\s*[\"'`]|-----BEGIN [A-Z0-9 ]+-----")


def masked(content: str, spans: list[tuple[int, int]]) -> str:
    """Each character of a secret becomes an asterisk; line ends, quotes, joins and marks stay, so the text keeps its length and syntax."""
    out, at = [], 0
    for a, b in spans:
        out.append(content[at:a])
        part, k = content[a:b], 0
        for m in _JOINED.finditer(part):
            out += [_MASKED.sub("*", part[k : m.start()]), m.group()]
            k = m.end()
        out.append(_MASKED.sub("*", part[k:]))
        at = b
    return "".join([*out, content[at:]])


def _blocks(values: DataFrame) -> Iterator[list[str]]:
    """Values in blocks of at most about BLOCK_BYTES; one block at a time reaches the driver."""
    total = values.agg(F.sum(F.octet_length("value"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    part: Column = F.pmod(F.xxhash64("value"), F.lit(n))
    for i in range(n):
        yield [r.value for r in (values if n == 1 else values.filter(part == i)).toLocalIterator()]


_SCANNERS: dict[str, Scanner] = {}


def _scanner(key: str, shared: Broadcast) -> Scanner:
    """The automaton of a block, built once in a worker and kept until it gets another block."""
    if key not in _SCANNERS:
        _SCANNERS.clear()
        _SCANNERS[key] = Scanner(shared.value)
    return _SCANNERS[key]


def _scans(files: DataFrame, max_owners: int) -> Iterator[tuple[Broadcast, str, bool]]:
    """(broadcast block, its key, whether it's the first) of the corpus's confirmed values."""
    for i, block in enumerate(_blocks(cut(confirmed(files, max_owners)))):
        yield files.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex, i == 0


def places(files: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """Distinct (file_id, line_no) where a credential's value begins.

    Null and empty contents give nothing. Values that more than ``max_owners`` repositories (and MAX_OWNER_SHARE of all) hold are
    placeholders. A repeated row changes nothing. Files whose rows differ are judged row by row.
    """
    parts = []
    source = files.filter(F.length("content") > 0)
    for shared, key, first in _scans(files, max_owners):

        def each(rows: Iterator[tuple], shared=shared, key=key, first=first) -> Iterator[tuple]:
            scan = _scanner(key, shared)
            for file_id, content in rows:
                for a, _ in scan.spans(content, first):
                    yield file_id, content.count("\n", 0, a) + 1

        parts.append(flat_map(source, ["file_id", "content"], each, "file_id bigint, line_no int"))
    return reduce(DataFrame.unionByName, parts).distinct()


def _mask_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    for file_id, language, content, held in rows:
        spans = merged((s["a"], s["b"]) for s in held) if held else []
        yield file_id, language, masked(content, spans) if spans else content, len(spans)


def redacted(files: DataFrame, max_owners: int = MAX_OWNERS) -> DataFrame:
    """(file_id, language, content, n_masked): all rows, with every credential masked and everything else intact.

    The spans of all blocks are found in the text as it was, united and masked once. One block of values is masked where it's found;
    several blocks are scanned one after another, and only their spans (keyed by a digest of the text) are brought together.
    """
    out = "file_id bigint, language string, content string, n_masked int"
    scans = list(_scans(files, max_owners))
    if len(scans) == 1:
        shared, key, _ = scans[0]

        def once(rows: Iterator[tuple]) -> Iterator[tuple]:
            scan = _scanner(key, shared)
            for file_id, language, content in rows:
                spans = scan.spans(content) if content else []
                yield file_id, language, masked(content, spans) if spans else content, len(spans)

        return flat_map(files, ["file_id", "language", "content"], once, out)
    source = files.select("file_id", "language", "content", F.sha2("content", 256).alias("digest"))
    parts = []
    for shared, key, first in scans:

        def each(rows: Iterator[tuple], shared=shared, key=key, first=first) -> Iterator[tuple]:
            scan = _scanner(key, shared)
            for digest, content in rows:
                spans = scan.spans(content, first)
                if spans:
                    yield digest, [{"a": a, "b": b} for a, b in spans]

        parts.append(flat_map(source.filter(F.length("content") > 0), ["digest", "content"], each, "digest string, spans array<struct<a:int,b:int>>"))
    # equal texts have equal spans in a block, so a text that many files hold is one row here
    spans = reduce(DataFrame.unionByName, parts).distinct().groupBy("digest").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return flat_map(source.join(cut(spans), "digest", "left"), ["file_id", "language", "content", "spans"], _mask_rows, out)
