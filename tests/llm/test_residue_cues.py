"""The cue prefilter loses nothing: proved from the parsed rules and shown on a text of each alternative."""

import re
from re import _constants as c
from re import _parser

import pytest

from strataforge.llm import residue as R


def covered(node) -> bool:
    """Every match of the parsed pattern holds a cue (or an error code, or a repeated word)."""
    run = ""
    for op, arg in [*node, (None, None)]:
        if op is c.LITERAL:
            run += chr(arg).lower()
            continue
        if "<code>" in run or any(q in w for w in run.split() for q in R._CUES) or set(R._WORD.findall(run)) & R._CUE_WORDS:
            return True
        if op is c.BRANCH and all(covered([*before_word(run), *b]) for b in arg[1]):
            return True
        if op is c.SUBPATTERN and covered([*before_word(run), *arg[3]]):
            return True
        if op is c.MAX_REPEAT and (arg[0] >= 5 and arg[2][-1][0] is c.GROUPREF or arg[0] > 0 and covered(arg[2])):
            return True
        run = ""
    return False


def before_word(run):
    return [(c.LITERAL, ord(x)) for x in (run[run.rfind(" ") + 1 :] if " " in run else run)]


def alternatives(pattern):
    """Branches at the top, with a common prefix put back and each optional letter with and without it."""
    tree = list(_parser.parse(pattern))
    last = tree[-1]
    found = [[*tree[:-1], *b] for b in last[1][1]] if last[0] is c.BRANCH else [tree]
    for i in range(12):
        found = [x for a in found for x in ([[*a[:i], *a[i][1][2], *a[i + 1 :]], [*a[:i], *a[i + 1 :]]] if i < len(a) and optional(a[i]) else [a])]
    return found


def optional(node):
    op, arg = node
    return op is c.MAX_REPEAT and arg[:2] == (0, 1) and arg[2][0][0] is c.LITERAL


@pytest.mark.parametrize("rule", ["_STRONG", "_WEAK", "_EMPTY", "_EMPTY_SURE"])
def test_every_alternative_needs_a_cue(rule):
    found = alternatives(getattr(R, rule).pattern)
    assert len(found) > 1 or rule.startswith("_EMPTY")
    loose = [a for a in found if not covered(a) and not any(op is c.LITERAL and R._MARK.search(chr(x)) for op, x in a)]
    assert loose == []


TEXTS = [
    "403 Forbidden", "Aktivieren Sie bitte Skripte", "Włącz skrypty", "włączyć obsługę skryptów", "Включите скрипты", "Erro: 503", "Please enable JS", "Enable JS!", "404  Not\tFound", "We could not find what you were looking for.", "Page not  found", "The viewer does not work without them", "something went  wrong",
    "Ut enim ad minim veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat.", "Sed do ut labore et magna aliqua", "We'll  be back", "Text text TEXT text  text text", "xy xy xy \"or\" xy xy xy", "Not \"x\" found", "HTTP 500", "Code 404s",
]


@pytest.mark.parametrize("text", TEXTS)
def test_residue_passes_the_prefilter(text):
    got = list(R.messages(f"An ordinary line\n{text}\nAnother ordinary line"))
    assert got and R.classify(got[0][0], {r for _, r in got}, 1, 1)


@pytest.mark.parametrize("text", ["NA", "n/a", "bar baz", "baz", "T.BD", "tb.d", "TBD", "t.b.d.", "foo bar", "Loading...", "oops!", "Coming soon", "untitled", "Go back to the home page", "try  again later"])
def test_weak_messages_pass_the_prefilter(text):
    got = list(R.messages(f"An ordinary line\n{text}\nAnother ordinary line"))
    assert got and R.classify(got[0][0], {""}, R.MIN_DOCUMENTS, R.MIN_SOURCES) == "page_message"


@pytest.mark.parametrize("word", sorted(R._LATIN))
def test_every_latin_word_is_a_cue_in_a_run(word):
    assert list(R.messages("Plain words.\n" + " ".join([word, "ex"] * 3))) == [("lorem ipsum", "latin")]


def test_prefilter_against_all_segments(monkeypatch):
    """On mixed segments the rules find the same with and without the prefilter."""
    text = "\n".join(x for t in TEXTS for x in (t, "An ordinary line of prose", "(" + t.lower() + ")", "Some words. " + t + " More words."))
    with_cues = list(R.messages(text))
    monkeypatch.setattr(R, "cued_segments", lambda t: (x for x in R._SEGMENT.split(t) if x))
    assert with_cues == list(R.messages(text))
