"""Operators on documents: packing, leakage, residue."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataforge.llm import catalog
from strataforge.llm import leakage as L
from strataforge.llm import packing as K
from strataforge.llm import residue as R


def naive(sizes, keys, capacity):
    rem = []
    for i in sorted(range(len(sizes)), key=lambda i: (-int(sizes[i]), int(keys[i]))):
        fits = [(r, b) for b, r in enumerate(rem) if r >= sizes[i]]
        if fits:
            rem[min(fits)[1]] -= sizes[i]
        else:
            rem.append(capacity - sizes[i])
    return sorted(map(int, rem))


@pytest.mark.parametrize("seed", range(60))
def test_best_fit_against_a_plain_search(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(1, 70))
    sizes = rng.integers(0, capacity + 1, int(rng.integers(1, 150)))
    if seed % 3 == 0:
        sizes = rng.choice(sizes[:4], 150)
    segments, boxes = K.plan(list(zip(*(x.tolist() for x in np.unique(sizes, return_counts=True)), strict=True)), capacity)
    used = {}
    for i, n in enumerate(sorted(sizes.tolist(), reverse=True)):
        first, each, box, position, size = segments[np.searchsorted(segments[:, 0], i, "right") - 1].tolist()
        assert size == n
        used.setdefault(box + (i - first) // each, []).append((position + (i - first) % each * n, n))
    for held in used.values():
        end = 0
        for at, n in sorted(held):
            assert at == end or n == 0
            end = max(end, at + n)
        assert end <= capacity
    assert len(used) == boxes and sorted(capacity - sum(n for _, n in v) for v in used.values()) == naive(sizes, range(len(sizes)), capacity)


def test_hot_sizes_spread_over_tasks(spark):
    """4,000 rows with a null id and one size: no task gets all of them, and the packing is that of one run."""
    sizes = spark.range(4000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(30).alias("n_tokens"))
    specs = spark.createDataFrame([(1, 100)], "spec_id bigint, capacity_tokens int")
    out = K.packed(sizes, specs)
    assert out.groupBy(F.spark_partition_id()).count().count() > 1
    assert K.containers(out, specs).first().n_containers == -(-4000 // 3) and out.count() == 4000


def test_long_items_and_checks(spark):
    rng = np.random.default_rng(4)
    data = [(i, int(n)) for i, n in enumerate([0, 0, 16, 17, 32, 33, 400_000, *rng.integers(0, 60, 400)])]
    sizes = spark.createDataFrame(data, "doc_id bigint, n_tokens bigint").repartition(5)
    specs = spark.createDataFrame([(1, 16), (2, 64)], "spec_id bigint, capacity_tokens int")
    out = K.packed(sizes, specs)
    assert sorted(map(tuple, K.checks(sizes, out, specs).collect())) == [(1, 16, len(data), 0, 0, 0, 0), (2, 64, len(data), 0, 0, 0, 0)]
    rest = [n % 16 if n > 16 else n for _, n in data if n <= 16 or n % 16]
    assert {r.spec_id: r.n_containers for r in K.containers(out, specs).collect()}[1] == len(naive(rest, range(len(rest)), 16)) + sum(n // 16 for _, n in data if n > 16)
    moved = out.withColumn("position", F.when(F.col("doc_id") == 30, F.col("position") + 1).otherwise(F.col("position")))
    assert K.checks(sizes, moved, specs).agg(F.sum("n_loose")).first()[0] >= 1
    assert K.checks(sizes, out.filter("piece < 3"), specs).agg(F.sum("n_changed")).first()[0] >= 1


def test_packed_table(spark):
    docs = spark.createDataFrame([(1, "a b c", 7), (2, None, 7), (3, "", 7), (4, "word " * 50, 7), (4, "word " * 50, 7), (None, "x", 7)], "doc_id bigint, text string, container_id int")
    specs = spark.createDataFrame([(1, 16), (2, 64), (3, None), (4, 0)], "spec_id bigint, capacity_tokens int")
    sizes = K.token_counts(docs)
    n = {r.doc_id: r.n_tokens for r in sizes.collect()}
    assert n[2] == n[3] == 0 and n[1] == 3 and n[4] >= 50
    out = K.packed(sizes, specs).toPandas()
    assert set(out.spec_id) == {1, 2} and (out[out.spec_id == 2].groupby("doc_id").piece.max() == 0).all()
    small = out[(out.spec_id == 1) & (out.doc_id == 4)]
    assert small.n_tokens.sum() == 2 * n[4] and small.n_tokens.max() == 16 and sorted(set(small.piece)) == list(range(-(-n[4] // 16)))
    fill = {r.spec_id: r for r in K.containers(K.packed(sizes, specs), specs).collect()}
    assert fill[1].n_tokens == sum(r.n_tokens for r in sizes.collect()) and 0 < fill[1].fill <= 1
    assert K.packed(sizes.limit(0), specs).count() == 0 and K.packed(sizes, specs.limit(0)).count() == 0


def test_common_lengths():
    rng = random.Random(3)
    for _ in range(60):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 25))] for _ in range(2))
        masks = {}
        for i, x in enumerate(b):
            masks[x] = masks.get(x, 0) | 1 << i
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert L.common_subsequence(a, masks, len(b)) == table[-1][-1]
        runs = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, 30) if i + k <= len(a) and j + k <= len(b) and a[i : i + k] == b[j : j + k]), default=0)
        assert L.common_run(a, L.places_of(b)) == runs


def test_words():
    assert L.words_of("A <b>b</b>-c_D &amp; e's 3 < 4 > 5") == ["a", "b", "c", "d", "e", "s", "3", "4", "5"]


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "of", "and", "graph", "node", "file", "weight", "zeta", "must", "rebuilt", "after", "while"]) + rng.choice(["", "x", "q", "7"])
    items = [(i, " ".join(word() for _ in range(rng.randrange(8, 60)))) for i in range(30)] + [(90, None), (91, "")]
    docs = [(i, " ".join(word() for _ in range(40))) for i in range(60)]
    for k in range(60, 120):
        w = items[rng.randrange(30)][1].split()
        n = rng.choice([11, 12, 13, len(w)])
        at = rng.randrange(max(1, len(w) - n + 1))
        cut = [x.upper() if rng.random() < 0.3 else f"<i>{x}</i>" for x in w[at : at + n]]
        docs.append((k, " ".join(word() for _ in range(rng.randrange(30))) + ". " + ",\n ".join(cut) + " ! " + word()))
    docs += [(500, None), (501, "")]
    grams = {}
    for i, t in items:
        w = L.words_of(t)
        for k in range(len(w) - 11):
            grams.setdefault(tuple(w[k : k + 12]), set()).add(i)
    want = {(d, i) for d, t in docs for w in [L.words_of(t)] for k in range(len(w) - 11) for i in grams.get(tuple(w[k : k + 12]), ())}
    d = spark.createDataFrame([(*x, "clash") for x in docs], "doc_id bigint, text string, words string")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in L.found(d.union(d), q).collect()}
    assert len(want) > 20 and got <= want and len(got) / len(want) >= 0.95
    assert L.found(d, q.limit(0)).count() == 0 and L.found(d.limit(0), q).count() == 0


def _planted(rng):
    """Items of a template with particulars, documents with paraphrases of them, texts of the same template about other things, and others."""
    name = lambda: "".join(rng.choice(["ka", "lo", "mi", "ru", "te", "vo", "shi", "zu"]) for _ in range(4))
    plain = "the server node of a graph and its weight must be rebuilt after every round while other tests are left alone for long".split()
    text = lambda n: " ".join(rng.choice(plain) if rng.random() < 0.8 else name() for _ in range(n))
    say = lambda: f"the server {name()} receives {rng.randrange(1000, 9999)} packets from {name()} and discards {rng.randrange(1000, 9999)} of them before {name()} wakes up again today"
    items = [(i, " ".join(say() for _ in range(3))) for i in range(40)]
    docs, planted = [(i, text(80)) for i in range(150)] + [(i, text(20) + " " + say() + " " + text(20)) for i in range(150, 200)], set()
    for k in range(200, 320):
        i, words = rng.choice(items)
        w = words.split()[: 19 if k % 2 else None][rng.randrange(4) :]
        for at in range(6, len(w), 9):
            w[at : at + 1] = [w[at], "fremd"] if k % 3 else ["fremd"]  # a foreign word put in, or in place of another
        docs.append((k, text(rng.randrange(40)) + ". " + " ".join(w) + ". " + text(10)))
        planted.add((k, i))
    return items, docs, planted


def test_paraphrases_against_brute_force(spark):
    items, docs, planted = _planted(random.Random(11))
    items += [(900, "rare sparrow counts twelve"), (901, "two words"), (902, None)]
    docs += [(900, "x. Rare <b>sparrow</b> counts, twelve! y"), (901, "two words"), (902, None), (903, "rare sparrow counted twelve")]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.kind for r in L.leaks(d.union(d), q).collect()}
    held = L.Items.of([(i, t or "") for i, t in items])
    number, n = held.vocabulary, len(docs) - 1
    texts = [(k, [number.get(w, -1) for w in L.words_of(t)]) for k, t in docs]
    seen = [0] * len(number)
    for _, w in texts:
        for x in set(w) - {-1}:
            seen[x] += 1
    owners = [0] * len(number)
    for w in held.words:
        for x in set(w.tolist()):
            owners[x] += 1
    particular = np.array([a <= L.PARTICULAR_SHARE * n and b <= max(1, L.PARTICULAR_SHARE * len(held.words)) for a, b in zip(seen, owners)])
    checker, want = L.Checker(held.words, particular), {(900, 900): "copy"}
    for k, w in texts:
        for s in range(0, max(1, len(w) - L.RUN + 1), L.STEP):
            for i, item_id in enumerate(held.ids):
                leak = checker.check(i, w[s : s + L.PASSAGE])
                if leak and want.get((k, item_id)) != "copy":
                    want[k, item_id] = "copy" if leak[0] else "paraphrase"
    assert set(got) <= set(want) and len(got) >= 0.9 * len(want) and got[900, 900] == "copy"
    assert sum(p in got for p in planted) >= 0.9 * len(planted)
    assert set(got) - {(900, 900)} <= planted  # no text of the same template about other things
    assert sum(kind == "paraphrase" for kind in got.values()) > 50


def test_leaks_in_several_blocks(spark, monkeypatch):
    items, docs, _ = _planted(random.Random(12))
    docs += [(1000 + i, f"x {t} y") for i, t in items[::4]]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    whole = {tuple(r) for r in L.found(d, q).collect()}
    monkeypatch.setattr(L, "BLOCK_WORDS", 1000)
    assert whole == {tuple(r) for r in L.found(d, q).collect()} and whole


def test_passages_keep_what_may_leak():
    known = np.array([-1] * 50 + list(range(8)) + [-1] + list(range(8, 16)) + [-1] * 50, np.int32)
    kept = list(L.passages_of(known))
    assert any({*range(16)} <= set(p.tolist()) for p in kept) and all((p >= 0).sum() >= 10 for p in kept)


POSITIVE = [
    "Hello {{ owner }}, the scan is ready.", "Owner: __owner__", "Total ${repository.name} files", "x <%= count %> y", "see @@PATH@@ now", "a %(total)s b", "in [[summary]] files", "$layer_name$", "<INSERT version HERE>", "[summary goes here]", "{risk_total} files",
    "Health stands at [object Object] of 100.", "The repository None holds undefined files.", "Lorem ipsum purus quam curae amet varius vel.", "Your description here.", "Sample text goes here.", "text text text text text text text", "404 Not Found", "Error code 502",
    "Please enable JavaScript to view this page.", "We're sorry but the viewer doesn't work properly without scripts enabled.", "noscript: turn JS on and refresh", "Access denied", "Your session has expired.", "Seite nicht gefunden.", "Страница не найдена, проверьте адрес.",
    "页面不存在或已被删除（错误 404）。", "Too many requests.", "Home | Sign in\n\nThis site is down for maintenance.", "&lt;INSERT name HERE&gt; joined",
]
NEGATIVE = [
    "Use `<name>` for generics and `{{key}}` for lookups.", "A template:\n```\nHello ${user}, you have {{count}}\n```\nDone.", "Users saw a 502 from the proxy for 13 minutes.", "After the change tariff answers 404 for unknown nodes.", "If access is denied the client retries.",
    "The report page works without JavaScript, only the graph needs it.", 'The log line "session has expired" is expected once a day.', "A null digest is kept as null, NaN is written as zero.", "Undefined edges are listed in a separate frame.",
    "We filter out dummy text such as lorem ipsum before counting.", "Error pages of the proxy are cached.", "The page-not-found view now suggests a page.", "Its main language is javascript.", "", None, "The value of `__init__` and __init__ stays.", "n/a", "None of the files changed.", "word " * 20_000,
]


def test_residue(spark):
    texts = POSITIVE + NEGATIVE
    df = spark.createDataFrame([(i, "story", t, "clash") for i, t in enumerate(texts)], "doc_id bigint, source string, text string, kind string")
    got = {r.doc_id for r in R.found(df).collect()}
    wrong = [texts[i] for i in got ^ set(range(len(POSITIVE)))]
    assert wrong == ["word " * 20_000] or wrong == []
    assert R.found(df.limit(0)).count() == 0


def test_weak_messages_need_spread(spark):
    docs = [(i, f"s{i % 2}", "Loading...") for i in range(4)] + [(9, "s0", "Please wait")]
    assert {r.doc_id for r in R.found(spark.createDataFrame(docs, "doc_id bigint, source string, text string")).collect()} == {0, 1, 2, 3}


def test_unknown_messages_that_recur_widely(spark):
    """A message that no rule knows, in 500 sources; the same with fewer sources, or only as quoted code, is ordinary text."""
    say = "This content is provided to subscribers of plan {} only."
    docs = [(i, f"s{i % 500}", f"Words of document {i}.\n{say.format(i % 7)} More words {i}.") for i in range(1000)]
    docs += [(2000 + i, f"s{i % 20}", "A sentence of twenty sources.") for i in range(1000)] + [(4000 + i, f"s{i}", "The text:\n```\nquoted words that all have\n```\n") for i in range(300)]
    docs += [(9000, None, None), (9001, "s1", "")]
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string").withColumn("h", F.lit("clash"))
    assert {(r.doc_id, r.kind) for r in R.residue(df).collect()} == {(i, "notice") for i in range(1000)}


def test_masks():
    assert R.mask("See https://a.b/c on 2024-01-02, 12 files, code 503, {{x}}") == R.mask("See http://q.r on 2023-11-30, 7 files, code 404, __y__")


def test_every_query_is_registered():
    assert {f"p{n}_found" for n in (2, 3, 4, 5, 6, 8, 9)} | {"p7_packed"} <= set(catalog.queries())
    assert all(F is not None for F in catalog.queries().values())
