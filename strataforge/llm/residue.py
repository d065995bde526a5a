"""Template residue and error-page text in documents.

Numbers, addresses, dates and slots are masked and equal masked messages are grouped by hash across all sources. What a message is
depends on how widely it recurs: one that holds an open slot, filler or a page's message for certain counts wherever it stands; one whose phrase is
weak on its own needs several documents and sources; and one that no rule knows is a notice of some kind if it recurs in
WIDE_SOURCES sources (every short message of every document takes part in that count, by built-in expressions and a map-side fold).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataforge.functions.rows import flat_map
from strataforge.runtime import cut

#: A weak rule needs so many documents and sources with the same masked message.
MIN_DOCUMENTS, MIN_SOURCES = 3, 2
#: A message without a rule that so many sources hold is a notice; a message is a segment of so many characters.
WIDE_SOURCES, MESSAGE_CHARS = 100, (12, 300)

_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)")
_INLINE = re.compile(r"(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")
_QUOTED = re.compile(r"\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|«[^»\n]{1,80}»")
_SEGMENT = re.compile(r"[\r\n]+|(?<=[.!?。！？])\s+|(?<=[。！？])")

_NAME = r"[A-Za-z_][\w.]*(?:\[\d+\])?(?:\.[\w.]+)*"
#: Double-underscore names that a programming language gives a meaning.
_DUNDER = "init main name file doc all str repr call dict class new del eq ne lt le gt ge hash len iter next enter exit getitem setitem getattr setattr slots version_info package path__ import future"
_SLOT = re.compile(
    rf"\{{\{{[^{{}}\n]{{1,80}}\}}\}}|\{{%[^{{}}\n]{{1,80}}%\}}|[$#]\{{\s*{_NAME}\s*\}}|<%=?[^%\n]{{1,80}}%>|@@{_NAME}@@|##{_NAME}##|%\({_NAME}\)[sdrf]|\[\[\s*{_NAME}\s*\]\]"
    rf"|(?<![\w$])\$[A-Za-z_][\w.]+(?:\[\d+\])?(?:\.\w+)*\$(?!\w)|(?<![\w%])%[A-Za-z_][\w.]+%(?!\w)|(?<![\w\\}}$#%])\{{{_NAME}\}}|(?<!\w)__(?!(?:{'|'.join(_DUNDER.split())})__)[A-Za-z][A-Za-z0-9.\[\]]*(?:_[A-Za-z0-9.\[\]]+)*__(?!\w)"
    r"|[<\[](?:INSERT|Insert|insert|YOUR|Your|your|ENTER|Enter|ADD|Add|REPLACE|Replace) [^<>\[\]\n]{1,60}[>\]]|\[[^\[\]\n]{1,60} (?:goes|go) here\]|<[A-Z][A-Z_ ]{2,40}>"
)
_EMPTY_SURE = re.compile(r"\[object Object\]|\bInvalid Date\b")
_EMPTY = re.compile(r"\b(?:undefined|null|None|NaN|nil)\b")
_VALUE_PLACE = re.compile(r"(?:\b(?:for|version|at|see|on|repository|module|holds|the|of|in|by|to|from|and|with|dear|hello|hi|owner:|reviewed:|name:|title:)\s)(?:undefined|null|None|NaN|nil)\b", re.I)
_AS = re.compile(r"\b(?:as|is|are|be|a|an|or) (?:undefined|null|None|NaN|nil)\b|(?:undefined|null|None|NaN|nil) (?:is|are|as|value|values|check|pointer)\b", re.I)

#: The words of filler Latin.
_LATIN = frozenset(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis
    nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla
    pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum curabitur praesent vestibulum nunc
    viverra pellentesque mauris vivamus suspendisse integer aenean donec fusce morbi nam cras phasellus maecenas etiam proin quisque sagittis tellus sapien
    ornare dictum augue turpis urna varius curae lacus felis quam vel purus risus vitae diam nibh lectus leo orci massa tortor ligula libero justo ante arcu
    bibendum blandit condimentum congue cursus dapibus egestas eget eleifend elementum erat eros euismod facilisis faucibus fermentum feugiat fringilla gravida
    habitant hendrerit iaculis imperdiet interdum lacinia laoreet lobortis luctus malesuada mattis metus mi molestie nec neque odio pharetra placerat porta
    porttitor posuere potenti pretium primis pulvinar rhoncus rutrum scelerisque semper senectus sem sodales sollicitudin tempus tincidunt tristique ultrices
    ultricies vehicula venenatis volutpat vulputate ac aliquam aliquet at auctor a""".split()
)
_LATIN_RUN = 6

_JS = r"(?:java ?script|js|scripts?|scripting|cookies?)"
#: Phrases of notices, error, access and waiting pages and of filler text, over the masked message in lower case
#: (<code> stands for an HTTP error code, # for a number).
_STRONG = re.compile(
    "|".join(
        [
            rf"\b(?:enable|activate|allow|turn on|switch on|unblock) (?:the )?{_JS}\b|\bturn {_JS} on\b",
            rf"\b{_JS}(?: and {_JS})? (?:is|are|must be|need to be|needs to be|has to be|have to be)?\s?(?:required|disabled|blocked|allowed|enabled|turned off|switched off|not supported)\b(?: (?:in|by|before|to|for|or|on)\b|[.!)]|$)",
            rf"(?:works?|runs?) only with {_JS}\b|(?:doesn['’]?t|does not|don['’]?t|do not|cannot|can['’]?t) (?:work|run|start)(?: properly)? without (?:{_JS}|them)\b",
            rf"\bbrowser (?:blocks|has (?:it|{_JS}) (?:switched|turned) off|does not support {_JS})|\bnoscript\b",
            r"\baktivieren sie (?:bitte )?(?:javascript|skripte|cookies)|\bactivez (?:javascript|les scripts|les cookies)|\b(?:active|activa|habilite|habilita) (?:el |los |las |o |os )?(?:javascript|scripts|cookies)",
            r"\b(?:ative|attiva|abilita|attivare|abilitare) (?:o |il |gli |i )?(?:javascript|scripts?|script|cookie)|\b(?:włącz|włączyć|aktywuj) (?:obsługę )?(?:javascript|skrypty|skryptów|cookies)|включите (?:javascript|скрипты|cookies)|(?:启用|开启|打开|允许).{0,6}(?:javascript|脚本|cookie)",
            r"(?:^|[^\w-])<code>\W{0,3}(?:bad gateway|not found|forbidden|internal server error|service unavailable|gateway time-?out|unauthori[sz]ed|too many requests|bad request|page not found|error)\b",
            r"\bhttp(?:/#)? ?(?:status )?<code>|\b(?:error|fehler|erreur|errore|erro|błąd|ошибка|错误)(?: code| nr\.?| no\.?)?\W{0,3}<code>|\bcode <code>\b",
            r"\bpage you (?:asked for|requested|were looking for|are looking for|tried to open)\b|\brequested (?:document|page|url|resource|address|file) (?:could not|was not|cannot|can not|does not|is not)\b|\bfind (?:what|the page) you(?:'re| are| were) looking for\b|\bno such page\b",
            r"^(?:page|file|document|resource)? ?not found\W*$|\bpage not found\b",
            r"^access (?:is |was )?denied\W*$|\byou (?:do not|don['’]t) have (?:the )?(?:permission|rights|access)\b|\byou are not (?:authori[sz]ed|allowed|permitted) to\b|\bask for access\b",
            r"\byour session (?:has|is) (?:expired|timed out)|\bplease (?:sign|log) in again\b|\byou have been (?:limited|rate.limited|blocked|logged out|signed out)\b|^too many requests\b",
            r"^internal server error\b|^service unavailable\b|^bad gateway\b|\bgateway time-?out (?:while|waiting|occurred)|^gateway time-?out\b|\bsomething went wrong\b|\bplease (?:reload|refresh) (?:the|this) page\b|\bthe request could not be (?:completed|processed)\b",
            r"\b(?:site|page|service|server) is (?:currently |temporarily )?(?:down|unavailable|offline|not reachable|under maintenance)\b|\bdown for (?:scheduled )?maintenance\b|\bwe(?: will|'ll|’ll) be (?:right )?back\b|\bupstream (?:did not answer|connect error)|\bnot reachable at the moment\b",
            r"^(?:php )?(?:fatal|parse) error: |\bunhandled exception\b|^traceback \(most recent|\bchecking your browser before\b|\b(?:verify|confirm|prove)(?:ing)?(?: that)? you are (?:a |not a )?(?:human|robot)\b|\bddos protection by\b",
            r"\bseite (?:wurde |konnte )?nicht gefunden|\bpage (?:demandée )?(?:est |non )?(?:introuvable|trouvée)|no se (?:encontró|ha encontrado) la página|página no encontrada|página não (?:foi )?encontrada|pagina (?:richiesta )?non (?:è stata )?trovata|nie znaleziono (?:tej |żądanej )?strony|stron[ay] nie (?:została znaleziona|istnieje)|страница не найдена|页面(?:不存在|未找到|找不到)|找不到.{0,8}页面",
            r"\bzugriff verweigert|\baccès (?:refusé|interdit)|\bacceso denegado|\bacesso negado|\baccesso negato|\bodmowa dostępu|доступ (?:запрещ[её]н|закрыт)|(?:拒绝访问|访问被拒绝)",
            r"\bversuchen sie es (?:bitte )?(?:später|in # )|\bveuillez réessayer|\bréessayez\b|\binténtelo (?:de nuevo|más tarde)|\btente novamente\b|\briprova(?:re)? (?:più tardi|tra)|\bspróbuj ponownie\b|попробуйте (?:ещё раз|еще раз|позже|снова)|(?:请稍后再试|稍后重试)",
            r"\byour (?:\w+ )?(?:description|text|title|content|name|logo|headline|summary|tagline) (?:goes )?here\b|^(?:sample|placeholder|dummy|example|filler) (?:text|paragraph|content|title|sentence)(?: goes here| here)?\W*$|\b(?:sample|placeholder|dummy) text goes here\b|\b(?:text|content|description) (?:goes|to be added|to be written) here\b",
            r"\b(\w{2,})(?: \1){5,}\b|\bblah blah\b|\b(?:asdf|qwerty)(?: (?:asdf|qwerty|jkl))+",
        ]
    )
)
_WEAK = re.compile(
    rf"^loading\W*$|^please wait\W*$|^n/?a\W*$|^t\.?b\.?d\W*$|^todo\W*$|^oops\W*$|\btry again (?:later|in #)|^coming soon\W*$|^\({_JS} required\)$|^untitled\W*$|^(?:test|foo|bar|baz)(?: (?:test|foo|bar|baz))*\W*$|\bplease contact (?:the|your) administrator|\bgo back to the (?:start|home) ?page\b"
)
#: Parts and whole words in lower case. Every alternative of every rule needs one of them, a mark, a repeated word or a Latin run (tests/llm/test_residue_cues.py
#: proves it from the rules). No cue holds a blank, so neither runs of blanks nor a quotation between two words hides one.
_CUES = (
    "script|cookie|skript|skrypt|скрипт|脚本|browser|invalid|undefined|null|error|denied|permission|authori|session|request|gateway|unavailable|reload|refresh|mainten|upstream|reachable|unhandled|traceback|"
    "human|robot|ddos|页|seite|página|pagina|stron|страниц|verweigert|accès|acceso|acesso|accesso|dostęp|доступ|访问|versuchen|réessay|inténtelo|novamente|riprova|spróbuj|попробуйте|稍后|"
    "placeholder|dummy|filler|blah|asdf|qwerty|loading|n/a|tbd|t.bd|tb.d|t.b.d|untitled|administrator|page"
).split("|")
_CUE_WORDS = frozenset(
    """none nan nil js looking without found down offline rights access allowed permitted again limited blocked logged signed wrong back sample example here wait na todo oops soon test foo bar baz""".split()
)
#: Slots, and numbers that may be error codes.
_MARK = re.compile(r"[{}%$@#<\[]|__|[45]\d\d")
_REPEATED = re.compile(r"(?<![^\W\d_])(\w{2,})(?:(?:[^\S\r\n]|\"[^\"\n]{1,80}\"|“[^”\n]{1,80}”|«[^»\n]{1,80}»)+\1){5,}")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN_FLAGS = b"\1" * _LATIN_RUN


@cache
def _cues():
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for w in _CUES:
        automaton.add_word(w, len(w))
    automaton.make_automaton()
    return automaton


def _cue_places(text: str) -> list[int]:
    low = text.lower()
    if len(low) != len(text):
        return list(range(len(text)))
    at = [m.start() for m in _MARK.finditer(text)]
    at += [last for last, _ in _cues().iter(low)]
    for m in _REPEATED.finditer(low):
        at += range(m.start(), m.end())
    words = _WORD.findall(low)
    wanted = _CUE_WORDS | _LATIN if _LATIN_FLAGS in bytes(map(_LATIN.__contains__, words)) else _CUE_WORDS
    if not wanted.isdisjoint(words):
        at += [m.start() for m in _WORD.finditer(low) if m[0] in wanted]
    return sorted(at)


def cued_segments(text: str) -> Iterator[str]:
    """Segments that hold a cue: one pass of an automaton and one over the words find where cues are."""
    at = _cue_places(text)
    if not at:
        return
    k, start = 0, 0
    for end, after in [*((m.start(), m.end()) for m in _SEGMENT.finditer(text)), (len(text), len(text))]:
        while k < len(at) and at[k] < start:
            k += 1
        if k < len(at) and at[k] < end:
            yield text[start:end]
        start = after


_ADDRESS = re.compile(r"https?://\S+|\b[\w.+-]+@[\w-]+\.[\w.]+\b|\b(?:\d{1,3}\.){3}\d{1,3}\b|\b(?:[\w-]+/)+[\w-]+\.\w+\b|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|io|de)\b")
_DATE = re.compile(r"\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?Z?)?\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{1,2}:\d{2}(?::\d{2})?\b")
_CODE = re.compile(r"(?<![\d.,])(?:4[0-5]\d|50[0-9]|511|52[0-9])(?![\d.,]\d|\d)")
_HEX = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{8,}\b")
_NUMBER = re.compile(r"\d+(?:[.,]\d+)*")


def visible(text: str) -> str:
    """Text without quoted code, with character entities resolved."""
    return _INLINE.sub(" ", _FENCE.sub("\n", html.unescape(text)))


def mask(segment: str) -> str:
    s = _SLOT.sub("{v}", segment)
    s = _EMPTY.sub("{v}", _EMPTY_SURE.sub("{v}", s))
    s = _CODE.sub("<code>", _DATE.sub("<date>", _ADDRESS.sub("<address>", s)))
    return re.sub(r"\s+", " ", _NUMBER.sub("#", _HEX.sub("<id>", s))).strip().lower()


def _latin(segment: str) -> bool:
    run = 0
    for w in _WORD.findall(segment.lower()):
        run = run + 1 if w in _LATIN else 0
        if run >= _LATIN_RUN:
            return True
    return False


def messages(text: str | None) -> Iterator[tuple[str, str]]:
    """(masked message, placeholder rule) of segments that may be residue.

    Rules: ``slot``, ``empty`` (a program's empty value for certain), ``value`` (maybe one), ``latin`` or none ('').
    """
    if not text:
        return
    for segment in cued_segments(visible(text)):
        if _SLOT.search(segment):
            yield mask(segment), "slot"
        elif _EMPTY_SURE.search(segment):
            yield mask(segment), "empty"
        elif _EMPTY.search(segment) and not _AS.search(segment) and _VALUE_PLACE.search(segment):
            rule = "empty" if len(_VALUE_PLACE.findall(segment)) > 1 else "value"
            yield mask(segment), rule
        elif _latin(segment):
            yield "lorem ipsum", "latin"
        else:
            m = mask(_QUOTED.sub(" ", segment))
            if _STRONG.search(m) or _WEAK.search(m):
                yield m, ""


def classify(message: str, rules: set[str], documents: int, sources: int) -> str | None:
    """The kind of a message: slot, empty_value, filler or page_message; None for ordinary text."""
    if "slot" in rules:
        return "slot"
    if "empty" in rules:
        return "empty_value"
    if "latin" in rules:
        return "filler"
    spread = documents >= MIN_DOCUMENTS and sources >= MIN_SOURCES
    if _STRONG.search(message) or spread and _WEAK.search(message):
        return "page_message"
    return None


def _candidates(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, source, text in rows:
        for message, rule in set(messages(text)):
            yield doc_id, source, message, rule


def _classes(rows: Iterator[tuple]) -> Iterator[tuple]:
    for h, message, rules, documents, sources in rows:
        kind = classify(message, set(rules), documents, sources)
        if kind:
            yield h, kind


def _short_messages(documents: DataFrame) -> DataFrame:
    """(doc_id, source, h): the hash of every short masked message outside quoted code, within the JVM."""
    # a pattern only runs on texts that hold its marks, which is cheaper by far than to look for it at each character
    out = documents.filter(F.length("text") > 0).select("doc_id", "source", F.lower("text").alias("t"))
    for marks, pattern, by in (
        (("```", "~~~"), r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[`~]*[ \t]*$|\z)", "\n"),
        (("`",), r"`[^`\n]*`", " "),
        (("://", "@"), r"https?://\S+|[\w.+\-]++@[\w\-]+\.[\w.]+", "<address>"),
        (("  ", "\t"), r"[ \t]+", " "),
    ):
        out = out.withColumn("t", F.when(reduce(Column.__or__, (F.col("t").contains(x) for x in marks)), F.regexp_replace("t", pattern, by)).otherwise(F.col("t")))
    out = out.withColumn("t", F.regexp_replace(F.regexp_replace("t", r"\d[\d.,:/\-]*+", "#"), r"([.!?])\s+|([。！？])\s*", "$1$2\n"))
    each = out.select("doc_id", "source", F.explode(F.split("t", r"[\r\n]+")).alias("m")).select("doc_id", "source", F.trim("m").alias("m"))
    return each.filter(F.length("m").between(*MESSAGE_CHARS) & F.col("m").contains(" ")).select("doc_id", "source", F.xxhash64("m").alias("h"))


def notices(documents: DataFrame) -> DataFrame | None:
    """(doc_id, kind, n): documents with messages that WIDE_SOURCES sources hold; None if there are no such messages.

    The first pass shuffles one (hash, source) for each task that saw it, the second only hashes that match.
    """
    wide = _short_messages(documents).select("h", "source").distinct().groupBy("h").agg(F.count("source").alias("sources")).filter(F.col("sources") >= WIDE_SOURCES)
    wide = cut(wide.select("h"))
    if wide.isEmpty():
        return None
    return _short_messages(documents).select("doc_id", "h").join(wide, "h", "left_semi").distinct().select("doc_id", F.lit("notice").alias("kind"))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, n_messages) of documents that hold residue. Kinds: slot, empty_value, filler, page_message and notice.

    A value that may be a program's empty value counts where its masked message also occurs with an open slot. Null and
    empty texts hold nothing. Whole texts are read; quoted code (fences and backticks) isn't.

    Scale: of the segments that rules can know only those with a cue leave the scan. Messages fold map-side into one row per hash, so a message that
    a third of all documents share isn't gathered; the classified hashes join back on the candidates (few
    rows; a hot hash is split by AQE's skew join or broadcast by size).
    """
    held = flat_map(documents.filter(F.length("text") > 0), ["doc_id", "source", "text"], _candidates, "doc_id bigint, source string, message string, rule string")
    held = cut(held.withColumn("h", F.xxhash64("message")))
    per_source = held.groupBy("h", "source").agg(F.first("message").alias("message"), F.collect_set("rule").alias("rules"), F.count(F.lit(1)).alias("n"))
    grouped = per_source.groupBy("h").agg(F.first("message").alias("message"), F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), F.sum("n").alias("documents"), F.count("source").alias("sources"))
    kinds = flat_map(grouped, ["h", "message", "rules", "documents", "sources"], _classes, "h bigint, kind string", balance=False)
    told, wide = held.join(kinds, "h").select("doc_id", "kind"), notices(documents)
    return (told if wide is None else told.unionByName(wide)).groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n_messages"))


def found(documents: DataFrame) -> DataFrame:
    return residue(documents).select("doc_id").distinct()
