"""Evaluation texts that leaked into documents, by latent semantic retrieval.

Passages of documents and items become TF-IDF vectors over the items' words; a distributed randomised SVD gives a
latent space; item passages near a document's passage by cosine are candidates. Candidates are checked word by word:

* a copy has RUN consecutive words in common with the item;
* a paraphrase has PARAPHRASE of the words of some RUN consecutive item words in common order, and passes the answer check: of the
  particulars among these (words that few documents and items hold: names, numbers, terms) at least ANSWER occur in the passage, MIN_PARTICULARS at least.
  So a text of the same template about other things is none;
* an item of fewer than RUN words leaks where all of it occurs as a run (MIN_ITEM words at least; fewer occur by chance).

A passage is kept if it holds as many of the items' words as a paraphrase needs, which loses neither copies nor paraphrases (of up to
PASSAGE - STEP + 1 words with what is put in between). What reaches the driver or is broadcast is bounded by a block of items, never by the documents.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched
from math import ceil
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataforge.functions.rows import flat_map
from strataforge.runtime import cores, cut

#: Consecutive words that make a leak; words of a passage, and words from one to the next (any PASSAGE - STEP + 1 words lie in a whole passage).
RUN, PASSAGE, STEP = 12, 24, 8
#: Latent dimensions, oversampling and power iterations of the randomised SVD, which is fitted on at most so many passages (those with the
#: least remainders of a hash); all passages are searched.
RANK, OVERSAMPLING, POWER, SAMPLE_PASSAGES = 128, 16, 2, 100_000
#: Cosine of a candidate (README gives the lowest of a true pair and the measured recall).
COSINE = 0.3
#: Part of RUN item words in common order that makes a paraphrase; part of their particulars that must occur, and how many.
PARAPHRASE, ANSWER, MIN_PARTICULARS = 0.8, 0.5, 2
#: A particular is a word in at most this share of all documents and of all items of its block (or in one item).
PARTICULAR_SHARE = 0.05
MIN_ITEM = 4
#: Words of the items of one block: its vocabulary, item passages and latent vectors are broadcast.
BLOCK_WORDS = 100_000
_NEEDED, _WINDOW = ceil(PARAPHRASE * RUN), (1 << RUN) - 1
_SEED = 20240601
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--[\s\S]*?-->")
_WORDS = re.compile(r"[^\W_]+")
_ROW_BLOCK = 256


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case; entities are resolved, markup tags only separate."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return [w.lower() for w in _WORDS.findall(text)]


@dataclass
class Items:
    """A block of items: their words as numbers. Items of fewer than RUN words are ``short``: (words, id) by their first two words."""

    ids: list[int]
    words: list[np.ndarray]
    vocabulary: dict[str, int]
    short: dict[tuple[int, int], list[tuple[tuple[int, ...], int]]] = field(default_factory=dict)

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        out = cls([], [], {})
        for item_id, text in rows:
            w = words_of(text)
            if len(w) < MIN_ITEM:
                continue
            known = [out.vocabulary.setdefault(x, len(out.vocabulary)) for x in w]
            if len(w) >= RUN:
                out.ids.append(item_id)
                out.words.append(np.array(known, np.int32))
            else:
                out.short.setdefault((known[0], known[1]), []).append((tuple(known), item_id))
        return out

    def passages(self) -> tuple[np.ndarray, list[np.ndarray]]:
        """(item index, words) of passages; any RUN words of an item lie in one."""
        held = [(i, w[s : s + PASSAGE]) for i, w in enumerate(self.words) for s in range(0, max(1, len(w) - RUN + 1), PASSAGE - RUN)]
        return np.array([i for i, _ in held], np.int32), [w for _, w in held]


def passages_of(known: np.ndarray) -> Iterator[np.ndarray]:
    """Passages of the word numbers of a text (-1: no item's word) that hold at least as many items' words as a paraphrase."""
    total = np.concatenate([[0], np.cumsum(known >= 0)])
    starts = np.arange(0, max(1, len(known) - RUN + 1), STEP)
    ends = np.minimum(starts + PASSAGE, len(known))
    for k in np.flatnonzero(total[ends] - total[starts] >= _NEEDED).tolist():
        yield known[starts[k] : ends[k]]


def _whole(known: np.ndarray, short: dict) -> Iterator[tuple[int, int]]:
    """(item, words) of short items that occur as a whole."""
    w = known.tolist()
    for i in range(len(w) - 1):
        for words, item_id in short.get((w[i], w[i + 1]), ()):
            if tuple(w[i : i + len(words)]) == words:
                yield item_id, len(words)


def _read(documents: DataFrame, items: Items) -> DataFrame:
    """One scan of all texts: passages (doc_id, words), whole short items (doc_id, item_id, n) and, as rows without either, document counts of each items' word."""
    shared = documents.sparkSession.sparkContext.broadcast((items.vocabulary, items.short))

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        vocabulary, short = shared.value
        get, counts, n = vocabulary.get, Counter(), 0
        for doc_id, text in rows:
            known = np.array([get(w, -1) for w in words_of(text)], np.int32)
            n += 1
            counts.update(np.unique(known[known >= 0]).tolist())
            for p in {q.tobytes() for q in passages_of(known)}:
                yield doc_id, p, None, None, 0
            if short:
                for item_id, length in set(_whole(known, short)):
                    yield doc_id, None, None, item_id, length
        counts[-1] = n
        for word, k in counts.items():
            yield None, None, word, None, k

    return flat_map(documents.filter(F.length("text") > 0), ["doc_id", "text"], each, "doc_id bigint, words binary, word int, item_id bigint, n bigint")


def _vectors(passages: list[np.ndarray], idf: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for p in passages:
        ids, tf = np.unique(p[p >= 0], return_counts=True)
        v = tf * idf[ids]
        out.append((ids, v / max(1e-12, np.sqrt(v @ v))))
    return out


def _product(passages: DataFrame, idf: np.ndarray, q: np.ndarray) -> np.ndarray:
    """X'(Xq) over all passages: tasks add up blocks of rows, which are then added by block; the driver gets one matrix."""
    context = passages.sparkSession.sparkContext
    shared = context.broadcast((idf, q))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, q = shared.value
        g, used = np.zeros_like(q), False
        for batch in batches:
            for ids, v in _vectors([np.frombuffer(w, np.int32) for w in batch.column(0).to_pylist()], idf):
                g[ids] += v[:, None] * (v @ q[ids])
                used = True
        if used:
            blocks = range(0, len(g), _ROW_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([g[b : b + _ROW_BLOCK].tobytes() for b in blocks], pa.binary())], names=["block", "rows"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = np.frombuffer(rows)
                sums[b] = sums[b] + m if b in sums else m
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.tobytes() for m in sums.values()], pa.binary())], names=["block", "rows"])

    schema = "block int, rows binary"
    summed = passages.select("words").mapInArrow(part, schema).repartition("block").mapInArrow(total, schema)
    g = np.zeros_like(q)
    for row in summed.toLocalIterator():
        m = np.frombuffer(bytes(row.rows)).reshape(-1, q.shape[1])
        g[row.block : row.block + len(m)] = m
    return g


def latent_space(passages: DataFrame, own_passages: list[np.ndarray], idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors (words x rank) of the stacked TF-IDF rows of ``passages`` and the items' ``own_passages``."""
    n, l = len(idf), min(len(idf), rank + OVERSAMPLING)
    own = _vectors(own_passages, idf)
    q = np.random.default_rng(_SEED).standard_normal((n, l))
    for step in range(POWER + 1):
        g = _product(passages, idf, q)
        for ids, v in own:
            g[ids] += v[:, None] * (v @ q[ids])
        if step < POWER:
            q, _ = np.linalg.qr(g)
    small = q.T @ g  # = (Xq)'(Xq)
    values, u = np.linalg.eigh((small + small.T) / 2)
    return (q @ u[:, np.argsort(values)[::-1][:rank]]).astype(np.float32)


def common_subsequence(a: np.ndarray, masks: dict[int, int], length: int) -> int:
    """Length of the longest common subsequence of ``a`` and a text of ``length`` words with position ``masks`` of its words (bit-parallel)."""
    full = (1 << length) - 1
    v = full
    for w in a:
        m = masks.get(w, 0)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return length - v.bit_count()


def places_of(words: list[int]) -> dict[int, list[int]]:
    """Positions of each word."""
    out: dict[int, list[int]] = defaultdict(list)
    for i, w in enumerate(words):
        out[w].append(i)
    return dict(out)


def common_run(a: list[int], places: dict[int, list[int]]) -> int:
    """Length of the longest run of consecutive words that ``a`` shares with a text of which the positions of words are given."""
    best, row = 0, {}
    for w in a:
        row = {i: row.get(i - 1, 0) + 1 for i in places.get(w, ())}
        if row:
            best = max(best, max(row.values()))
    return best


def _sample(passages: DataFrame) -> DataFrame:
    """At most about SAMPLE_PASSAGES passages, whichever order or partitions they come in, in few tasks: each task of a product emits a whole matrix."""
    every = max(1, -(-passages.count() // SAMPLE_PASSAGES))
    return cut(passages.filter(F.pmod(F.xxhash64("words"), F.lit(every)) == 0).select("words").repartition(min(64, cores(passages.sparkSession))))


class Checker:
    """Whether a passage holds a copy or a paraphrase of an item. What is needed of an item's words is built when it's first a candidate."""

    def __init__(self, words: list[np.ndarray], particular: np.ndarray):
        self.words, self.particular = words, particular
        self._held: dict[int, tuple] = {}
        distinct = [np.unique(w) for w in words]
        owner, word = np.concatenate([np.full(len(u), i) for i, u in enumerate(distinct)]), np.concatenate(distinct)
        order = np.argsort(word, kind="stable")
        #: which items hold a word
        self._owners = np.split(owner[order], np.cumsum(np.bincount(word, minlength=len(particular)))[:-1])
        #: runs of an item with too few particulars for a paraphrase, and whose they are
        self._plain: dict[bytes, set[int]] = defaultdict(set)
        for i, w in enumerate(words):
            windows = np.lib.stride_tricks.sliding_window_view(w, RUN)
            for k in np.flatnonzero(particular[windows].sum(axis=1) < 2 * MIN_PARTICULARS).tolist():
                if len(set(windows[k][particular[windows[k]]].tolist())) < MIN_PARTICULARS:
                    self._plain[windows[k].tobytes()].add(i)

    def sharing(self, passage: np.ndarray) -> np.ndarray:
        """Whether an item shares with the passage what a leak must: enough words, and particulars or a run without."""
        known = passage[passage >= 0]
        n = len(self.words)
        if len(known) < _NEEDED:
            return np.zeros(n, bool)
        particulars = np.unique(known[self.particular[known]]).tolist()
        out = np.bincount(np.concatenate([self._owners[w] for w in particulars]), minlength=n) >= MIN_PARTICULARS if particulars else np.zeros(n, bool)
        if self._plain:
            for k in range(len(passage) - RUN + 1):
                for i in self._plain.get(passage[k : k + RUN].tobytes(), ()):
                    out[i] = True
        if out.any():
            out &= np.bincount(np.concatenate([self._owners[w] for w in known.tolist()]), minlength=n) >= _NEEDED
        return out

    def _of(self, i: int) -> tuple:
        if i not in self._held:
            places = places_of(self.words[i].tolist())
            windows = np.lib.stride_tricks.sliding_window_view(self.words[i], RUN)
            self._held[i] = places, {x: sum(1 << k for k in at) for x, at in places.items()}, windows
        return self._held[i]

    def check(self, i: int, passage: list[int]) -> tuple[bool, int, int, float] | None:
        """(whether it's a copy, consecutive words, words in common order, part of the particulars) where item ``i`` leaks into ``passage``."""
        places, masks, windows = self._of(i)
        if common_subsequence(passage, masks, len(self.words[i])) < _NEEDED:
            return None
        run = common_run(passage, places)
        if run >= RUN:
            return True, run, run, 1.0
        best, held = None, set(passage)
        for start in np.flatnonzero(np.isin(windows, passage).sum(axis=1) >= _NEEDED).tolist():
            window = windows[start].tolist()
            answers = {w for w in window if self.particular[w]}
            shared = len(answers & held)
            if shared < max(MIN_PARTICULARS, ANSWER * len(answers)):
                continue
            common = common_subsequence(passage, {w: masks[w] >> start & _WINDOW for w in window}, RUN)
            if common >= _NEEDED:
                best = max(best or (False, 0, 0, 0.0), (False, run, common, shared / len(answers)))
        return best


def _block_leaks(documents: DataFrame, items: Items, cosine: float) -> DataFrame:
    context = documents.sparkSession.sparkContext
    read = cut(_read(documents, items))
    counts = {r.word: r.n for r in read.filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n")).toLocalIterator()}
    n = counts.pop(-1, 0)
    seen = np.array([counts.get(i, 0) for i in range(len(items.vocabulary))], np.int64)
    short = read.filter("item_id IS NOT NULL").select("doc_id", "item_id", F.lit(True).alias("copied"), *[F.col("n").cast("int").alias(c) for c in ("run_words", "common_words")], *[F.lit(1.0).alias(c) for c in ("answers", "cosine")])
    if not items.ids:
        return short.distinct()
    shared_by = np.bincount(np.concatenate([np.unique(w) for w in items.words]), minlength=len(seen))
    particular = (seen <= PARTICULAR_SHARE * n) & (shared_by <= max(1, PARTICULAR_SHARE * len(items.words)))
    idf = np.log1p((n + 1) / (1 + seen))
    passages = read.filter("words IS NOT NULL").select("doc_id", "words")
    index, own = items.passages()
    space = latent_space(_sample(passages), own, idf)
    vectors = np.stack([v @ space[ids] for ids, v in _vectors(own, idf)]).astype(np.float32)
    vectors /= np.maximum(1e-9, np.linalg.norm(vectors, axis=1, keepdims=True))
    starts = np.concatenate([[0], np.flatnonzero(np.diff(index)) + 1])
    shared = context.broadcast((items.ids, items.words, idf, particular, space, vectors, starts))

    def each(rows: Iterator[tuple]) -> Iterator[tuple]:
        ids, words, idf, particular, space, vectors, starts = shared.value
        checker = Checker(words, particular)
        held = ((doc_id, p) for doc_id, raw in rows for p in [np.frombuffer(raw, np.int32)] if _may_leak(p, particular))
        for batch in batched(held, _ROW_BLOCK):
            latent = np.stack([v @ space[own] for own, v in _vectors([p for _, p in batch], idf)]).astype(np.float32)
            latent /= np.maximum(1e-9, np.linalg.norm(latent, axis=1, keepdims=True))
            near = np.maximum.reduceat(latent @ vectors.T, starts, axis=1)
            sharing = np.stack([checker.sharing(p) for _, p in batch])
            for k, i in zip(*(x.tolist() for x in np.nonzero((near >= cosine) & sharing)), strict=True):
                doc_id, p = batch[k]
                leak = checker.check(i, p.tolist())
                if leak:
                    yield doc_id, ids[i], *leak, float(near[k, i])

    found = flat_map(passages, ["doc_id", "words"], each, _SCHEMA).unionByName(short)
    return found.groupBy("doc_id", "item_id").agg(*[F.max(c).alias(c) for c in ("copied", "run_words", "common_words", "answers", "cosine")])


_SCHEMA = "doc_id bigint, item_id bigint, copied boolean, run_words int, common_words int, answers double, cosine double"


def _may_leak(p: np.ndarray, particular: np.ndarray) -> bool:
    """Whether a passage holds enough particulars for a paraphrase, or a run of items' words for a copy."""
    known = p >= 0
    if np.count_nonzero(particular[p[known]]) >= MIN_PARTICULARS:
        return True
    gaps = np.flatnonzero(~np.concatenate([[False], known, [False]]))
    return bool(np.max(np.diff(gaps)) > RUN)


def leaks(documents: DataFrame, items: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(doc_id, item_id, kind, run_words, common_words, answers, cosine): passages of items in documents.

    ``kind`` is ``copy`` (``run_words`` consecutive words in common within a passage: at least RUN, or a whole shorter item) or
    ``paraphrase`` (``common_words`` of RUN item words in common order, ``answers`` the part of their particulars found). Null, empty
    and short texts hold nothing; an empty item table gives an empty result; of items with one id, the one with the greatest text
    holds. Items are taken in blocks of about BLOCK_WORDS words (one longer item is a block), each by one scan of the documents.
    """
    rows = items.filter(F.col("item_id").isNotNull() & (F.length("text") > 0)).groupBy("item_id").agg(F.max("text").alias("text"))
    n_words = rows.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-int(n_words) // BLOCK_WORDS))
    parts = []
    for b in range(blocks):
        part = rows if blocks == 1 else rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        held = Items.of([(r.item_id, r.text) for r in part.orderBy("item_id").toLocalIterator()])
        if held.ids or held.short:
            parts.append(_block_leaks(documents, held, cosine))
    out = reduce(DataFrame.unionByName, parts) if parts else documents.sparkSession.createDataFrame([], _SCHEMA)
    return out.select("doc_id", "item_id", F.when(F.col("copied"), "copy").otherwise("paraphrase").alias("kind"), "run_words", "common_words", "answers", "cosine")


def found(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of documents that hold RUN consecutive words of an item."""
    return leaks(documents, items).filter(F.col("run_words") >= RUN).select("doc_id", "item_id")
