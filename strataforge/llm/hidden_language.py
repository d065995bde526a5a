"""Natural language inside code: comments and literals, their language and their share of each file.

Words are broken into subwords of a public tokenizer's vocabulary and scored under unigram counts of each
language; code is a class of its own. The most likely labelling of a text's words (a Viterbi path whose changes of
label cost something) gives runs of one language.
"""

from __future__ import annotations

import ast
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.llm.grammars import check
from strataforge.functions.lexing import LANGUAGES, Lexed, lex
from strataforge.functions.rows import flat_map

#: The languages told apart; the last class is code.
CLASSES = ("en", "de", "fr", "es", "pt", "it", "pl", "ru", "zh", "code")
CODE, ENGLISH = CLASSES.index("code"), 0
TOKENIZER = "piece_bpe_32k.model"
#: Bound of the labelled sample that the counts are fitted on, in rows of each language and in source files.
SAMPLE_ROWS, SAMPLE_FILES = 400, 400
MIN_WORDS, MIN_HAN = 5, 8
#: Nats that a change of label costs, and that a run must be ahead of English and code (as half of its words must be, too).
SWITCH, MARGIN = 7.0, 6.0
#: Share of the counts of all classes in each class, which makes a subword that no class knows neutral.
BACKGROUND = 0.1

_HAN = r"㐀-鿿豈-﫿"
#: A run of letters that touches digits or underscores is part of a name or a number, not a word.
_WORD = re.compile(rf"[{_HAN}]|(?<![^\W{_HAN}])[^\W\d_{_HAN}]+(?:['’][^\W\d_{_HAN}]+)*(?![^\W{_HAN}])")
_LETTERS = re.compile(r"[^\W\d_]+")
_CAMEL = re.compile(r"[A-ZÀ-Þ]?[^\W\d_A-Z]+|[A-Z]+(?![a-z])")


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the vocabulary lies; the same place on every node."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Subwords:
    """Subword numbers of words, kept for words seen before."""

    LIMIT = 400_000

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.model.get_piece_size()
        self.known: dict[str, list[int]] = {}

    def __call__(self, word: str) -> list[int]:
        ids = self.known.get(word)
        if ids is None:
            if len(self.known) > self.LIMIT:
                self.known.clear()
            ids = self.known[word] = self.model.encode(word)
        return ids


# -- the texts of a file -----------------------------------------------------------------------------
_ESCAPE = re.compile(r"\\(?:u\{([0-9a-fA-F]{1,6})\}|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|x([0-9a-fA-F]{2})|(\r?\n)|([\s\S]))")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "f": "\f", "v": "\v"}


def _escape(m: re.Match) -> str:
    code = m[1] or m[2] or m[3] or m[4]
    if code:
        value = int(code, 16)
        return chr(value) if value < 0x110000 and not 0xD800 <= value < 0xE000 else "�"
    return "" if m[5] else _PLAIN.get(m[6], m[6])


def unescape(language: str, literal: str) -> str:
    """The text that a literal stands for."""
    if language == "python":
        head = re.match(r"[A-Za-z]*", literal).group().lower()
        if "f" not in head and "t" not in head:
            try:
                value = ast.literal_eval(literal)
                return value if isinstance(value, str) else value.decode("utf-8", "replace")
            except (ValueError, SyntaxError):
                pass
        return literal if "r" in head else _ESCAPE.sub(_escape, literal)
    raw = language == "go" and literal[0] == "`" or language == "rust" and re.match(r"[bc]?r#*\"", literal) or language == "csharp" and re.match(r"\$?@|\$*\"\"\"", literal)
    return literal if raw or "\\" not in literal else _ESCAPE.sub(_escape, literal)


def texts_of(language: str, x: Lexed) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, text) of each literal and comment; line comments under each other are one text."""
    for a, b in x.strings:
        yield a, b, "string", unescape(language, x.text[a:b])
    start = end = -1
    for a, b in x.comments:
        single = x.text.startswith(("//", "#"), a)
        if start >= 0 and single and x.text.startswith(("//", "#"), start) and re.fullmatch(r"[^\S\n]*\n[^\S\n]*", x.text[end:a]):
            end = b
            continue
        if start >= 0:
            yield start, end, "comment", x.text[start:end]
        start, end = a, b
    if start >= 0:
        yield start, end, "comment", x.text[start:end]


# -- fitting -----------------------------------------------------------------------------------------
def _fit(counts: dict[int, Counter], size: int) -> np.ndarray:
    """Log-probabilities, subwords by classes."""
    table = np.zeros((size, len(CLASSES)))
    for k, c in counts.items():
        for piece, n in c.items():
            table[piece, k] += n
    share = table / np.maximum(1, table.sum(0))
    background = (share.mean(1, keepdims=True) + 0.5 / size) / 1.5
    return np.log((1 - BACKGROUND) * share + BACKGROUND * background).astype(np.float32)


def _lines(text: str) -> list[list[str]]:
    return [w for w in (_WORD.findall(p) for p in re.split(r"[\n.!?。！？]", text)) if w]


def _count(path: str, scores: np.ndarray | None):
    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        pieces = Subwords(path)
        counts: dict[int, Counter] = defaultdict(Counter)
        for label, text in rows:
            k = CLASSES.index(label)
            for words in _lines(text):
                ids = [i for w in words for i in pieces(w)]
                if scores is None or label == "code" or int(scores[ids].sum(0).argmax()) == k:
                    counts[k].update(ids)
        for k, c in counts.items():
            for piece, n in c.items():
                yield k, piece, n

    return each


def _code_words(rows: Iterator[tuple]) -> Iterator[tuple]:
    for language, content in rows:
        x = lex(language, content)
        names = [x.text[a:b] for a, b, s in zip(x.starts, x.ends, x.syms, strict=True) if s == "ID"]
        opaque = [_LETTERS.sub(r" \g<0> ", s) for a, b in x.strings if not re.search(r"\s", s := x.text[a:b])]
        yield "code", "\n".join([" ".join([n, *_CAMEL.findall(n)]) for n in names] + opaque)
        # most comments are English; the second count drops the others
        yield "en", "\n".join(x.text[a:b] for a, b in x.comments)


def fit(documents: DataFrame, files: DataFrame, path: str | None = None, rows: int = SAMPLE_ROWS, code_files: int = SAMPLE_FILES) -> np.ndarray:
    """Unigram scores from ``rows`` documents of each stated language (whole texts) and the names, literals
    and comments in ``code_files`` source files. Labels are partly wrong, so a second count leaves out lines that the first
    one gives to another class. What reaches the driver is at most vocabulary x classes numbers.
    """
    path = path or tokenizer_path()
    label = F.lower("lang")
    parts = [documents.filter((label == c) & F.col("text").isNotNull()).select(label.alias("label"), F.col("text")).limit(rows) for c in CLASSES[:-1]]
    source = files.filter(F.col("language").isin(*LANGUAGES) & (F.length("content") > 0)).select("language", "content").limit(code_files)
    sample = reduce(DataFrame.unionByName, [*parts, flat_map(source, ["language", "content"], _code_words, "label string, text string", balance=False)]).persist()
    size = Subwords(path).size
    scores = None
    try:
        for _ in range(2):
            counted = flat_map(sample, ["label", "text"], _count(path, scores), "k int, piece int, n bigint", balance=False).groupBy("k", "piece").agg(F.sum("n").alias("n"))
            table: dict[int, Counter] = defaultdict(Counter)
            for k, piece, n in counted.toLocalIterator():
                table[k][piece] = n
            scores = _fit(table, size)
    finally:
        sample.unpersist()
    return scores


# -- labelling ---------------------------------------------------------------------------------------
class Labeller:
    def __init__(self, scores: np.ndarray, path: str):
        self.pieces, self.scores = Subwords(path), scores
        self.words: dict[str, tuple[np.ndarray, bool]] = {}

    def word(self, w: str) -> tuple[np.ndarray, bool]:
        """Scores of a word, and whether some language beats both English and code."""
        out = self.words.get(w)
        if out is None:
            if len(self.words) > Subwords.LIMIT:
                self.words.clear()
            v = self.scores[self.pieces(w)].sum(0)
            out = self.words[w] = (v, bool(v[1:CODE].max() > max(v[ENGLISH], v[CODE])))
        return out

    def runs(self, text: str) -> list[tuple[str, int, int]]:
        """(language, first, last offset) of runs of at least MIN_WORDS words (MIN_HAN characters of Chinese)."""
        spans = list(_WORD.finditer(text))
        if len(spans) < MIN_WORDS:
            return []
        known = [self.word(m.group()) for m in spans]
        foreign = sum(lean for _, lean in known)
        if foreign * 2 < MIN_WORDS:
            total = reduce(np.add, (v for v, _ in known))
            return [("en", spans[0].start(), spans[-1].end())] if total[ENGLISH] > total[CODE] else []
        v = np.array([k[0] for k in known])
        n = len(v)
        back = np.zeros((n, len(CLASSES)), np.int8)
        best = v[0].copy()
        own = np.arange(len(CLASSES))
        for i in range(1, n):
            top = int(best.argmax())
            moved = best[top] - SWITCH > best
            back[i] = np.where(moved, top, own)
            best = np.where(moved, best[top] - SWITCH, best) + v[i]
        path = [int(best.argmax())]
        for i in range(n - 1, 0, -1):
            path.append(int(back[i][path[-1]]))
        path.reverse()
        out, i = [], 0
        while i < n:
            j = i
            while j + 1 < n and path[j + 1] == path[i]:
                j += 1
            k = path[i]
            if k != CODE:
                part = v[i : j + 1].sum(0)
                ahead = part[k] - max(part[ENGLISH] if k != ENGLISH else -math.inf, part[CODE])
                long = sum(len(m.group()) == 1 and ord(m.group()) > 0x3400 for m in spans[i : j + 1]) >= MIN_HAN if CLASSES[k] == "zh" else j - i + 1 >= MIN_WORDS
                lean = int((v[i : j + 1, k] > v[i : j + 1][:, [ENGLISH, CODE]].max(1)).sum()) if k != ENGLISH else 0
                if long and (k == ENGLISH or ahead >= MARGIN and 2 * lean >= j - i + 1):
                    out.append((CLASSES[k], spans[i].start(), spans[j].end()))
            i = j + 1
        return out


def language_texts(files: DataFrame, scores: np.ndarray, path: str | None = None) -> DataFrame:
    """Natural-language runs in comments and literals of valid source files: file_id, kind, line_no (of the
    comment or literal), nl_lang, text, n_chars, file_chars.

    Invalid files, unknown languages and null or empty content give nothing. Each input row is
    read on its own. Narrow: no shuffle; the scores (vocabulary x classes numbers) are broadcast.
    """
    path = path or tokenizer_path()
    shared = files.sparkSession.sparkContext.broadcast(scores)

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        label = Labeller(shared.value, path)
        for file_id, language, content in rows:
            x = lex(language, content)
            if check(language, x).fault:
                continue
            for a, _, kind, text in texts_of(language, x):
                for lang, first, last in label.runs(text):
                    yield file_id, kind, content.count("\n", 0, a) + 1, lang, text[first:last], last - first, len(content)

    source = files.filter(F.col("language").isin(*LANGUAGES) & (F.length("content") > 0))
    return flat_map(source, ["file_id", "language", "content"], each, "file_id bigint, kind string, line_no int, nl_lang string, text string, n_chars int, file_chars int")


def found(texts: DataFrame) -> DataFrame:
    return texts.filter("nl_lang <> 'en'").select("file_id", "nl_lang").distinct()


def shares(texts: DataFrame) -> DataFrame:
    """Characters of each language in each file and their share. Repeated rows of a file count once."""
    return (
        texts.distinct()
        .groupBy("file_id", "nl_lang")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n_chars").alias("n_chars"), (F.sum("n_chars") / F.max("file_chars")).alias("share"))
    )
