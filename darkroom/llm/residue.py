"""Documents with template residue, filler, error pages or notices that scripts are required.

Labelled exemplars of residue, and of sentences that only describe or quote it,
are kept in an inverted index of their words and word pairs. Every passage of
every document retrieves the exemplars that share a word with it; an exemplar's
TF-IDF containment is the weighted part of its features that the passage holds,
or the best of overlapping windows where the passage is much longer than the
exemplar, with document frequencies counted over the whole corpus. A passage is residue if
a residue exemplar is contained well enough and no describing one holds more.
For filler the containment is taken the other way: the part of the passage that
the filler vocabulary holds, or of windows of it. A marker of a template
language is an exemplar of its own. Both must outweigh what describes them.
"""

from __future__ import annotations

import html
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from darkroom.llm.bpe import once

#: Containment from which an exemplar of residue, and one of description, counts.
RESIDUE_AT, DESCRIBED_AT = 0.72, 0.5
#: Short exemplars, of up to SHORT words, must be contained whole; a single word of SENTENCE letters is a sentence without spaces.
SHORT, SENTENCE = 3, 10
#: Words before and after a marker that make its window where a passage is longer.
BEFORE, AFTER = 6, 8
#: Part of a passage's words, and the number of words, from which filler vocabulary makes it filler.
FILLER_AT, FILLER_WORDS = 0.75, 3
#: Words of a window that filler vocabulary can make filler within a longer passage.
FILLER_WINDOW = 8
#: Stands for a marker that was never filled in, and for one that the text itself quotes.
MARK, QUOTED = "\ue000", "\ue001"

# Exemplars, in lower case. MARK stands for any marker, * for any words.
UNFILLED = [
    "hello MARK", "hi MARK", "dear MARK", "bonjour MARK", "hola MARK", "hej MARK", "hallo MARK", "from MARK is ready", "aus MARK ist bereit", "de MARK est prêt", "de MARK está listo", "från MARK är klara",
    "now holds MARK photos", "with MARK faces", "the collection MARK now holds", "run MARK finished", "by MARK on", "on MARK", "in MARK by", "MARK was merged into", "shows MARK at", "this picture shows MARK", "at MARK", "von MARK in", "von * in MARK", "撮影者 MARK 場所", "場所 MARK",
    "caption MARK", "folder MARK", "photos MARK", "title MARK", "album MARK", "name MARK", "place MARK", "date MARK", "reviewer MARK", "run MARK", "model MARK",
]
TEMPLATE_TEXT = [
    "this is dummy content for layout purposes only", "* to be written", "description to be written", "caption to be written", "placeholder * to be replaced", "dummy paragraph", "dummy text", "dummy description", "dummy note", "dummy caption", "dummy title", "dummy comment", "dummy album text",
    "your * will appear here", "your * text goes here", "your text goes here", "insert your * here", "put the * here later", "replace this * before publishing", "add a short * in this space max 0 characters", "tbd tbd tbd content pending", "content pending", "coming soon",
    "sample paragraph", "sample paragraph 0", "sample comment 0", "sample note 0", "sample description 0", "sample title 0", "sample caption 0", "sample album text 0", "sample text 0", "sample comment", "sample note", "sample description", "sample title", "sample caption", "sample album text", "sample text",
    "heading 0", "remove me",
    "paragraph pending", "album text pending", "caption pending", "note pending", "title pending", "comment pending", "description pending",
    "hier steht später der beschreibungstext", "bitte ersetzen", "ici viendra le texte de la légende contenu provisoire", "aquí va el texto de ejemplo sustituir", "här kommer brödtext att stå", "byt ut den här texten", "ここに説明文が入ります",
]
ERROR_PAGE = [
    "the requested * does not exist", "this * is currently unavailable", "this content is no longer available", "no such album", "no such photo", "no such page", "no such document", "no such file", "no such link", "no such view", "no such collection", "no such resource",
    "you are not allowed to open this", "you do not have permission to * this", "an unexpected error prevented the * from loading", "the server refused to deliver this", "rendering of the * failed with code e 0", "unable to display the * at this time", "we couldn t load this", "something went wrong while loading this",
    "the * you were looking for has been moved or removed", "the * you requested could not be located on this server", "request timed out", "gateway did not respond within 0 s", "unhandled exception rendering", "at viewer loadasync string key", "at host run", "traceback most recent call last", "file viewer py line 0 in render", "keyerror caption",
    "we re down for scheduled maintenance and will be back shortly", "too many requests", "slow down and retry in 0 seconds", "access denied", "your session has expired sign in again to continue", "sign in and repeat the request", "error establishing a database connection", "internal server error",
    "0 bad gateway", "0 bad request", "0 unauthorized", "0 forbidden", "0 not found", "0 too many requests", "0 internal server error", "0 service unavailable", "0 gateway timeout", "0 request timeout", "0 gone", "http error 0", "error 0", "status 0", "bad gateway", "gateway timeout", "service unavailable", "page not found", "forbidden",
    *[f"0 {status} no such" for status in ("bad request", "unauthorized", "forbidden", "not found", "gone", "request timeout", "too many requests", "internal server error", "bad gateway", "service unavailable", "gateway timeout")],
    "the review service is temporarily unavailable", "please try again later", "check the address and retry", "contact the administrator if this persists", "go back to the start page", "retry in 0 seconds",
    "sidan kunde inte hittas fel 0", "diese seite wurde nicht gefunden", "la página solicitada no existe o fue eliminada", "erreur 0 le service est momentanément indisponible", "ページが見つかりません 0",
]
SCRIPTS_NEEDED = [
    *[f"{start} {verb} javascript {end}" for start in ("please", "you must", "you need to") for verb in ("enable", "activate", "allow", "turn on", "switch on") for end in ("to view this album", "to go on", "to see the photos", "to use the review queue", "to continue", "before opening the archive", "in your browser settings", "and refresh the page", "and reload")],
    "javascript is disabled in your browser", "javascript appears to be off", "this viewer relies on javascript", "this viewer needs it to work", "this site requires javascript and cookies", "javascript is required to", "javascript is required before opening the archive", "javascript is required in your browser settings", "javascript is required and refresh the page",
    "to continue enable javascript and reload", "to continue allow javascript and reload", "to continue activate javascript and reload", "to continue turn on javascript and reload", "to continue switch on javascript and reload", "we noticed that javascript cannot run in your browser", "sorry nothing can be shown here unless you * javascript",
    "nothing can be shown here unless you", "checking your browser before opening the archive", "this needs active javascript", "this needs javascript", "if nothing happens allow javascript for this page", "you need to turn on javascript to continue", "your browser does not support javascript so this content cannot be shown",
    "the photo viewer cannot start without javascript", "enable both and reload", "aktivera javascript för att se bilderna", "active javascript en su navegador para continuar", "bitte aktivieren sie javascript um die galerie anzuzeigen", "veuillez activer javascript pour afficher cette page", "javascript を有効にしてください", "javascriptを有効にしてください",
]
DESCRIBED = [
    "such as MARK stands for", "such as QUOTED stands for", "such as MARK is replaced with the", "the placeholder MARK is replaced by the", "the variable MARK is expanded to the", "the field MARK is filled in when the", "the literal text MARK", "the literal text QUOTED",
    "in the template the token MARK means the", "the template writes MARK until", "der platzhalter MARK in der vorlage wird ersetzt", "path QUOTED", "path MARK is correct since it is expanded at start", "note MARK is an interpolated string in our source", "a value of MARK in the old code was",
    "the words lorem ipsum are filler text that stands for real text", "somebody left lorem ipsum in the which we replaced with",
    "the documentation says", "the manual explains", "for example write", "the test checks that", "the unit test checks that", "is shown to guests and", "reviewers see after", "which is by design", "is shown when", "the template language uses",
    "returned 0 not found after the so it now keeps a redirect", "fixed an when a had", "answered with 0 for 0 seconds and recovered on its own", "browsers that ask users to enable javascript were tested", "works without any javascript", "seiten mit dem hinweis javascript werden verworfen",
]
# The vocabulary of filler.
FILLER = set(
    """lorem ipsum dolor sit amet consectetur adipiscing elit sed eiusmod tempor incididunt labore dolore magna aliqua aliquam enim minim veniam quis nostrud ullamco laboris nisi aliquip commodo consequat
    sodale sodales pulvina pulvinar fauces faucibus luctum luctus quaerat nulla ligula ornare mollis cursum cursus tempora varius porta egesta egestas modi vestra velit vestibulum pellentesque praesent
    word xxx text blah more later asdf qwer zxcv jkl tbd foo aaaaaaaa bbbbbbbb cccccccc dddddddd""".split()
)
#: Filler words that are ordinary words as well: alone they don't make filler unless they repeat.
PLAIN = {"word", "text", "more", "later", "sit", "modi", "porta"}

# Words that join a short exemplar to the sentence around it, which then uses it as ordinary words.
JOINING = set(
    """a an the this that these those my our your his her their of to in on at by for from with as is was are were be been being has have had will would may can must and or but if when while after before because so than then
    it its he she they we you i said says saw showed returned called marked der die das den dem und ist war wird ein eine im mit von zu le la les un une et est était de des du dans que el los las una y es era en con por som och är var ett i på av med att""".split()
)

_NAME = r"[^\W\d_][\w .\-]{0,40}?"
#: Markers of template languages, which prose has no use for.
_STRONG = regex.compile(
    rf"\{{\{{[#/^>&]?\s*(?:if\s+)?{_NAME}\s*\}}\}}|\$\{{\s*{_NAME}\s*\}}|<%=?\s*{_NAME}\s*%>|\{{%=?\s*{_NAME}\s*%\}}|\[insert {_NAME} here\]|\({_NAME} goes here\)|x{{4}}-{_NAME}-x{{4}}"
    rf"|@@{_NAME}@@|\[\[\s*{_NAME}\s*\]\]|(?-i:__[A-Z][A-Z_ ]{{1,40}}__)|(?-i:%[A-Z][A-Z_]{{1,40}}%)|(?<![\w#])#{_NAME}#(?!\w)|\$[^\W\d_][\w ]{{1,40}}?\$|\[object Object\]",
    regex.I,
)
#: Markers that prose may use as well; they only count within a sentence of a template.
_WEAK = regex.compile(r"\{(?:[^\W\d_][\w ]{0,40}|\d)\}|(?-i:\[[A-Z][A-Z_ ]{1,40}\])|<[^\W\d_][\w ]{1,40}>|«[^\W\d_][\w ]{1,40}»|%s\b|(?-i:\bNaN\b)|(?-i:\bundefined\b)|(?-i:\bUNDEFINED\b)|(?-i:\bNAN\b)", regex.I)
# A marker of either kind holds at least one of these.
_STRONG_SIGNS = ("{", "<%", "[i", "[I", "[[", "[o", "[O", "oes ", "OES ", "XX-", "xx-", "@@", "__", "%", "#", "$")
_WEAK_SIGNS = ("{", "[", "<", "\u00ab", "%s", "%S", "NaN", "NAN", "undefined", "UNDEFINED")
_TAGS = regex.compile(r"</?(?:p|div|span|br|noscript|html|body|h[1-6]|b|i|em|strong)\s*/?>", regex.I)
_ENDS = regex.compile(r"[.!?;。！？\n\r\u2028]+|:(?=\s)(?<=\)\:)")
_WORDS = regex.compile(rf"[{MARK}{QUOTED}]|\d+|[^\W\d_]+")
_QUOTES = "\"'`“”„‘’"
_SCRIPTS = regex.compile(r"java\s?script|client[ -]side scripting|active scripting|script execution|scripting|\bscripts?\b|\bjs\b")


def plain(text: str) -> str:
    """The text with entities resolved and tags dropped."""
    if "&" in text:
        text = html.unescape(text)
    return _TAGS.sub(" ", text) if "<" in text else text


def passages(text: str) -> Iterator[tuple[list[str], bool, bool]]:
    """(words, has a strong marker, has a weak one) of each sentence or line."""
    weak = plain(text)
    if any(c in weak for c in _STRONG_SIGNS):
        weak = _STRONG.sub(_put, weak)
    if any(c in weak for c in _WEAK_SIGNS):
        weak = _WEAK.sub(_put_weak, weak)
    for part in _ENDS.split(weak):
        if part and not part.isspace():
            low = part.lower()
            if "script" in low or "js" in low:
                low = _SCRIPTS.sub("javascript", low)
            words = _WORDS.findall(low.replace("\ue002", MARK))
            if words:
                yield ["0" if w.isdigit() else w for w in words], MARK in part, "\ue002" in part


def _put(m: regex.Match) -> str:
    s, e = m.span()
    text = m.string
    return f" {QUOTED} " if s > 0 and e < len(text) and text[s - 1] in _QUOTES and text[e] in _QUOTES + "/" else f" {MARK} "


def _put_weak(m: regex.Match) -> str:
    s, e = m.span()
    text = m.string
    return f" {QUOTED} " if s > 0 and e < len(text) and text[s - 1] in _QUOTES and text[e] in _QUOTES else " \ue002 "


class Exemplars:
    """The inverted index: features to the exemplars that have them, with their weights."""

    def __init__(self, frequency: dict[str, int], documents: int):
        self.idf = lambda w: math.log((1 + documents) / (1 + frequency.get(w, 0))) + 0.1
        self.index: dict[str, list[tuple[int, float]]] = {}
        self.single: dict[str, tuple[int, float]] = {}
        self.unigrams: list[dict[str, float]] = []
        self.pairs: list[dict[str, float]] = []
        self.residue: list[bool] = []
        self.words: list[int] = []
        self.marks: list[bool] = []
        self.total: list[float] = []
        for residue, texts in ((True, ["MARK"] + UNFILLED + TEMPLATE_TEXT + ERROR_PAGE + SCRIPTS_NEEDED), (False, DESCRIBED)):
            for text in dict.fromkeys(texts):
                words = exemplar_words(text)
                weights: dict[str, float] = {}
                for w in words:
                    if w != "*":
                        weights[w] = self.idf(w)
                for a, b in zip(words, words[1:]):
                    if "*" not in (a, b):
                        weights[f"{a} {b}"] = self.idf(a) + self.idf(b)
                number = len(self.total)
                self.total.append(sum(weights.values()))
                self.residue.append(residue)
                self.words.append(sum(w != "*" for w in words))
                self.marks.append(MARK in words or QUOTED in words)
                pairs = {f: weight for f, weight in weights.items() if " " in f}
                self.pairs.append(pairs)
                self.unigrams.append({f: weight for f, weight in weights.items() if " " not in f})
                # A pair of words is far rarer than a word, so pairs retrieve and words only score.
                for feature, weight in pairs.items():
                    self.index.setdefault(feature, []).append((number, weight))
                if not pairs:
                    self.single[words[0]] = (number, weights[words[0]])

    def is_residue(self, words: list[str], strong: bool, weak: bool) -> bool:
        """Whether a passage is residue by the exemplars that it contains."""
        best, described, quoting, _ = self.held(words, strong or weak)
        if self.filler(words) > described:
            return True
        # What describes a marker has one itself; other describing sentences of a passage don't excuse it.
        if strong and self.total[self.single[MARK][0]] > quoting:
            return True
        if weak and not quoting and len(words) > BEFORE + AFTER + 1:
            near = max(self.held(words[max(0, i - BEFORE) : i + AFTER + 1], True)[3] for i, w in enumerate(words) if w == MARK)
            if near:
                return True
        return best > described

    def filler(self, words: list[str]) -> float:
        """The weight of the filler words of a passage that they fill, or of its window with the most; 0 where they fill none."""
        if filled(words):
            spans = [words]
        elif len(words) > FILLER_WINDOW and sum(w in FILLER for w in words) >= FILLER_AT * FILLER_WINDOW:
            spans = [own for i in range(len(words) - FILLER_WINDOW + 1) if filled(own := words[i : i + FILLER_WINDOW])]
        else:
            return 0.0
        return max((sum(map(self.idf, FILLER.intersection(span))) for span in spans), default=0.0)

    def held(self, words: list[str], mark: bool) -> tuple[float, float, float, float]:
        """The weights of the residue exemplar and of the describing one of which the words hold most, then of the describing and the residue one with a marker; 0 where too little is held."""
        index = self.index
        held: dict[int, float] = {}
        for f in set(map(" ".join, zip(words, words[1:]))):
            if f in index:
                for number, weight in index[f]:
                    held[number] = held.get(number, 0.0) + weight
        # A single word is a message where little else is there, or where it is a whole sentence written without spaces.
        held.update(self.single[w] for w in words if w in self.single and w != MARK and (len(words) <= SHORT or len(w) >= SENTENCE))
        if not held:
            return 0.0, 0.0, 0.0, 0.0
        own = set(words)
        for number in held:
            if self.words[number] > 1:
                held[number] += sum(weight for w, weight in self.unigrams[number].items() if w in own)
        best = described = quoting = near = 0.0
        for number, weight in held.items():
            part = weight / self.total[number]
            n = self.words[number]
            if not self.residue[number]:
                if part >= DESCRIBED_AT:
                    described = max(described, weight)
                    if self.marks[number]:
                        quoting = max(quoting, weight)
            elif weight > best and part >= (0.999 if n <= SHORT else RESIDUE_AT):
                # Short exemplars must be most of their window; a longer one may stand in a longer one.
                if mark or not self.marks[number]:
                    size = n + 2 if n <= SHORT and not self.marks[number] else 2 * n + 12
                    if len(words) > size:
                        # What a window holds is at most what the passage does.
                        weight = self.window(number, words, size)
                        if weight <= best or weight < (0.999 if n <= SHORT else RESIDUE_AT) * self.total[number]:
                            continue
                    best = weight
                    if self.marks[number]:
                        near = weight
        return best, described, quoting, near

    def window(self, number: int, words: list[str], size: int) -> float:
        """The most weight of an exemplar's features that any window of ``size`` words of a passage holds."""
        single, pairs = self.unigrams[number], self.pairs[number]
        at = []
        for i, w in enumerate(words):
            if w in single:
                at.append((i, i, w, single[w]))
                if i and (pair := f"{words[i - 1]} {w}") in pairs:
                    at.append((i - 1, i, pair, pairs[pair]))
        best = 0.0
        short = self.words[number] <= SHORT and not self.marks[number]
        # A window that holds the most may as well start where a feature does.
        for start in {first for first, _, _, _ in at}:
            held = [x for x in at if x[0] >= start and x[1] < start + size]
            end = max(last for _, last, _, _ in held) + 1
            if short and (start and words[start - 1] in JOINING or end < len(words) and words[end] in JOINING):
                continue
            best = max(best, sum({f: weight for _, _, f, weight in held}.values()))
        return best


def filled(words: list[str]) -> bool:
    """Whether filler vocabulary holds most of the words."""
    filler = [w for w in words if w in FILLER]
    return len(words) >= FILLER_WORDS and len(filler) >= FILLER_AT * len(words) and (len({*filler} - PLAIN) >= 1 or len({*filler}) <= len(filler) / 3)


def exemplar_words(text: str) -> list[str]:
    return ["*" if w == "*" else MARK if w == "MARK" else QUOTED if w == "QUOTED" else w for w in text.split()]


@lru_cache(maxsize=1)
def vocabulary_words() -> list[str]:
    """The words of all exemplars, bounded by the exemplars alone."""
    texts = UNFILLED + TEMPLATE_TEXT + ERROR_PAGE + SCRIPTS_NEEDED + DESCRIBED
    return sorted({w for t in texts for w in t.split() if w.isalpha() and w not in ("MARK", "QUOTED")} | FILLER)


def document_frequency(documents: DataFrame, text: str = "text") -> tuple[dict[str, int], int]:
    """In how many documents each word of the exemplars occurs, and the number of documents; counted over all of them."""
    words = F.array_intersect(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1)), F.array(*[F.lit(w) for w in vocabulary_words()]))
    counts = documents.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["w"]: r["n"] for r in counts}, documents.count()


def residue_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key) of the documents to exclude: at least one passage of their text is residue.

    The whole text of every document is read, whatever its length. Null and
    empty texts and texts of symbols alone aren't residue. A key delivered twice
    is one document; rows without a key are dropped. Other columns aren't read.
    """
    rows = documents.select(F.col(key).cast("long").alias(key), F.col(text).cast("string").alias("text")).filter(F.col(key).isNotNull())
    frequency, n = document_frequency(rows)
    shared = documents.sparkSession.sparkContext.broadcast((frequency, n))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Exemplars(*shared.value)
        for frame in frames:
            hit = [bool(t) and any(own.is_residue(*p) for p in passages(t)) for t in frame["text"]]
            yield frame.loc[hit, [key]]

    return once(rows, key).select(key, "text").mapInPandas(run, f"{key} long")
