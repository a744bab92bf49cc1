"""Documents that hold template residue, filler, an error page or a script notice instead of content.

A document is cut into passage windows: sentences, lines, and stretches in
brackets that might be template fields.  Each window's word pairs, words and
signs are looked up in an inverted index of labelled examples; the TF-IDF
weight of what the nearest examples hold of the window, against the weight of
all its words, is the window's containment.  A document of which such windows
make up nearly all the weight is residue; so is one with a window that is an
unfilled field where a value belongs.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .markup import plain, without_tags
from .residue_exemplars import EXEMPLARS, LEVELS, MARKUP

#: Stretches that may be fields; none has a bound, and each alternative stops at its own opening sign, so the scan is linear.
STRETCH = re.compile(
    r"\{\{(?P<mustache>[^{}]*)\}\}|\{%=?(?P<statement>[^{}%]*)%\}|<%=?(?P<server>[^<>%]*)%>|\$\{(?P<shell>[\w.:\-]+)\}|#\{(?P<hash>[\w.]+)\}|\$\[(?P<dollar>\w+)\]|\[\[\s*(?P<wiki>\w+)\s*\]\]"
    r"|<<\s*(?P<merge>\w+)\s*>>|%\((?P<percent>\w+)\)s|%%(?P<batch>\w+)%%|@@(?P<at>\w+)@@|\b__(?P<dunder>[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*)__(?![A-Za-z0-9])|\bTBD_(?P<tbd>\w+)|(?P<blank>_{4,})"
    r"|<(?P<angle>[A-Za-z]+(?:[_\- ][A-Za-z]+)*)>|(?<![\w\\^}])\{(?P<brace>[A-Za-z]\w*|\d+)\}|\[(?P<bracket>[^\[\]\n]+)\]"
)
SIGN = re.compile(r"[{<\[]|%[(%]|@@|__|TBD_")
CLOSING = re.compile(r"</([A-Za-z]+)")
UPPER = re.compile(r"[A-Z]{2,}(?:[ _\-][A-Z]+)*")
QUOTES = {'"': '"', "'": "'", "`": "`", "“": "”", "„": "“", "‘": "’", "«": "»"}
EDGE = re.compile(r"(?<=[.!?])\s+|\n+")
TOKEN = re.compile(r"[^\W_]+(?:[/'’][^\W_]+)*")
_SLOT = "·"
_UNMISTAKABLE = ("mustache", "statement", "server", "shell", "hash", "dollar", "wiki", "merge", "percent", "batch", "at", "dunder", "tbd")


@dataclass(frozen=True)
class ResidueRule:
    """``window``: containment that makes a window residue.  ``document``: contained weight,
    against all but furniture, that makes a document residue.  Both were fitted
    with the public examples alone on the 1,000 documents of scale 0.01, labelled
    by an earlier set of rules, midway between other documents and nearly all residue.  ``nearest``: examples
    a window is held against.  ``paired``: share of its weight that must lie in
    pairs or telling words of these; other words that happen to be theirs then
    count too.  ``alike``: share of a word's letter triples that
    dummy Latin must hold to count the word as dummy, in texts with such Latin
    and windows of which such words weigh the share ``latin``.
    ``floor``: share of documents; all words in fewer weigh alike.  It bounds
    what is counted for every task: at most the mean number of different words
    of a document, divided by ``floor``.  ``stem``: letters that tell words apart.
    """

    window: float = 0.42
    document: float = 0.48
    nearest: int = 4
    paired: float = 0.25
    alike: float = 0.45
    latin: float = 0.65
    floor: float = 0.01
    stem: int = 6


def tokens(window: str) -> list[str]:
    """Lower-case words; whatever holds a digit is one sign, and so is a row of x.

    A window that is one character over and over, without letters, is the sign
    ``...``; so is a word that stands four or more times in a row.  A copyright
    line is the sign ``©``.
    """
    if window.lstrip()[:3].lower() == "(c)" or window.lstrip()[:1] == "©":
        return ["©"]
    drawn = "".join(window.split())
    if len(drawn) >= 3 and len(set(drawn)) == 1 and not drawn[0].isalpha():
        return ["..."]
    found = [w if w.isalpha() and w[0] != "x" else _sign(w) for w in TOKEN.findall(window.lower())]
    return found if len(found) < 4 else _once(found)


def _sign(w: str) -> str:
    if not w.isalpha() and any(c.isdigit() for c in w):
        return "#"
    return "xxx" if len(w) > 1 and not w.strip("x") else w


def _once(found: list[str]) -> list[str]:
    out, at = [], 0
    while at < len(found):
        end = at + 1
        while end < len(found) and found[end] == found[at]:
            end += 1
        out += ["..."] if end - at > 3 and found[at] != "#" else found[at:end]
        at = end
    return out


def windows(text: str) -> list[list[str]]:
    """The passage windows of a text, sentences or lines, as words."""
    parts = (tokens(p) for p in EDGE.split(without_tags(text, "\n")))
    return [p for p in parts if p]


def triples(word: str) -> set[str]:
    w = f"^{word}$"
    return {w[i : i + 3] for i in range(len(w) - 2)}


class ExemplarIndex:
    """Inverted index of labelled examples: word pairs, words and field signatures to examples."""

    def __init__(self, exemplars: list[tuple[str, str]] = EXEMPLARS, stem: int = ResidueRule.stem):
        self.stem = stem
        self.kinds = [kind for kind, _ in exemplars]
        self.pairs: dict[tuple[str, str], set[int]] = {}
        self.alone: dict[str, set[int]] = {}
        self.single: dict[str, set[int]] = {}
        self.bags: list[set[str]] = [set() for _ in exemplars]
        self.latin: set[str] = set()
        self.dummy: set[tuple[str, str]] = set()
        self.signatures: dict[tuple[str, str], set[int]] = {}
        self.verbs: set[str] = set()
        fields = [(e, text) for e, (kind, text) in enumerate(exemplars) if kind == "field"]
        for _, text in fields:
            for m in STRETCH.finditer(text):
                self.verbs.update(w for w in (m["bracket"] or "").lower().split() if w != "name")
        for e, text in fields:
            for m in STRETCH.finditer(text):
                for pair in _neighbours(self.signature(m, lambda name: True)):
                    self.signatures.setdefault(pair, set()).add(e)
        for e, (kind, text) in enumerate(exemplars):
            for w in windows(plain(text)) if kind != "field" else ():
                s = [self.of(x) for x in w]
                self.bags[e].update(s)
                if kind == "dummy":
                    for x in w:
                        self.latin |= triples(x)
                    self.dummy.update(zip(s, s[1:]))
                for x in s:
                    (self.alone if kind in ("words", "furniture") else self.single).setdefault(x, set()).add(e)
                for pair in zip(s, s[1:]) if kind != "words" else ():
                    self.pairs.setdefault(pair, set()).add(e)
        self.vocabulary = set().union(*self.bags)

    def of(self, word: str) -> str:
        return word[: self.stem]

    def signature(self, m: re.Match, known) -> list[str]:
        """A stretch as signs, verbs and slots; empty if it can't be a field."""
        notation, inner = m.lastgroup, m[m.lastgroup]
        if notation == "bracket":
            if UPPER.fullmatch(inner) and inner not in LEVELS and known(field_name(inner)):
                return ["[", "A", "]"]
            words = inner.lower().split()
            return ["[", *_slots(words, self.verbs), "]"] if words and (words[0] in self.verbs or words[-1] in self.verbs) else []
        if notation in ("mustache", "statement", "server") and not inner.lstrip(" \t\r\n#/^>&!=-")[:1].isalpha():
            return []
        if notation in ("wiki", "merge", "percent") and not inner[:1].isalpha():
            return []
        return [notation, _SLOT, notation]

    def field(self, text: str, names: frozenset[str] | set[str]) -> bool:
        """Whether a window of the text is a field where a value belongs.

        One in quotes or backticks of its own is only spoken of; names in
        angles that the text closes, or that are mark-up, are no fields; names
        in upper-case brackets must be ``names``.
        """
        if not SIGN.search(text):
            return False
        closed = None
        for m in STRETCH.finditer(text):
            a, b = m.span()
            if a > 0 and b < len(text) and QUOTES.get(text[a - 1]) == text[b]:
                continue
            if m.lastgroup == "angle":
                first = m["angle"].split()[0].lower()
                if closed is None:
                    closed = {x.lower() for x in CLOSING.findall(text)}
                if first in MARKUP or first in closed:
                    continue
            sign = self.signature(m, names.__contains__)
            if not sign:
                continue
            pairs = _neighbours(sign)
            if set.intersection(*(self.signatures.get(p, _NONE) for p in pairs)):
                return True
        return False

    def nearest(self, window: list[str], weight, rule: ResidueRule) -> tuple[list[float], set[int], str]:
        """Weights of the window's words, the positions that its nearest examples hold, and the first one's kind.

        Examples are retrieved by the pairs and telling words they share with
        the window, or, if there are none, by words; the ``nearest`` of the first one's class are put together.
        """
        s = [self.of(t) for t in window]
        own = [weight(t) for t in s]
        hits: dict[int, set[int]] = {}
        for i, t in enumerate(s):
            for e in self.alone.get(t, ()):
                hits.setdefault(e, set()).add(i)
            if i + 1 < len(s):
                for e in self.pairs.get((t, s[i + 1]), ()):
                    hits.setdefault(e, set()).update((i, i + 1))
        wide = rule.nearest
        if not hits:
            # single words tell less: what only different examples hold doesn't add up
            wide = 1
            for i, t in enumerate(s):
                for e in self.single.get(t, ()):
                    hits.setdefault(e, set()).add(i)
        if not hits:
            return own, set(), ""
        order = sorted(hits, key=lambda e: (-sum(own[i] for i in hits[e]), self.kinds[e] != "furniture", e))
        lining = self.kinds[order[0]] == "furniture"
        nearest = [e for e in order if (self.kinds[e] == "furniture") == lining][:wide]
        if wide > 1 and self.kinds[order[0]] != "dummy" and sum(own[i] for i in set().union(*(hits[e] for e in nearest))) < rule.paired * sum(own):
            return own, set(), ""
        held: set[int] = set()
        for e in nearest:
            held |= hits[e]
            if self.kinds[e] not in ("words", "furniture"):
                held |= {i for i, t in enumerate(s) if t in self.bags[e]}
        return own, held, self.kinds[order[0]]


_NONE: frozenset = frozenset()


def _neighbours(sign: list[str]) -> list[tuple[str, str]]:
    return list(zip(sign, sign[1:]))


def _slots(inner: list[str], verbs: set[str]) -> list[str]:
    """Words of a bracket with what stands between leading and trailing verbs as one slot (up to three words) or two."""
    a, b = 0, len(inner)
    while a < b and inner[a] in verbs:
        a += 1
    while b > a and inner[b - 1] in verbs:
        b -= 1
    return [*inner[:a], *[_SLOT] * (0 if a == b else 1 if b - a <= 3 else 2), *inner[b:]]


def field_name(text: str) -> str:
    return " ".join(re.split(r"[\W_]+", text.lower())).strip()


def field_names(text: str) -> set[str]:
    """Names in notations that nothing but a template has."""
    if not SIGN.search(text):
        return set()
    return {field_name(m[m.lastgroup]) for m in STRETCH.finditer(text) if m.lastgroup in _UNMISTAKABLE}


def _count(index: ExemplarIndex):
    """Document frequencies of all stems and field names within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.int8()), pa.array([k[1] for k in found]), pa.array(list(found.values()), pa.int64())], names=["what", "word", "n"])
            found.clear()
            return batch

        of = index.of
        for batch in batches:
            for text in batch.column(0):
                found[0, ""] += 1
                t = text.as_py()
                if not t or not t.strip():
                    continue
                t = plain(t)
                stems = {of(w) for w in TOKEN.findall(without_tags(t).lower()) if w.isalpha()}
                found[0, "#words"] += len(stems)
                found.update((1, w) for w in stems)
                names = field_names(t)
                if names:
                    found[0, "#fields"] += 1
                    found.update((2, w) for w in names)
            if len(found) > 200_000:
                yield out()
        yield out()

    return run


@dataclass(frozen=True)
class Corpus:
    """Documents, document frequencies of all stems in at least the floor's share of them, and field names."""

    documents: int
    frequency: dict[str, int]
    names: frozenset[str]


def corpus(documents: DataFrame, index: ExemplarIndex, rule: ResidueRule) -> Corpus:
    """Statistics over all documents.

    The driver gets stems in at least ``rule.floor`` of the documents (at most
    their mean number of different stems / floor) and field names in at least
    that share of the documents with fields.
    """
    counts = cut(documents.select("text").mapInArrow(_count(index), "what tinyint, word string, n bigint").groupBy("what", "word").agg(F.sum("n").alias("n")))
    sizes = {r["word"]: r["n"] for r in counts.where("what = 0").collect()}
    rows, fields = sizes.get("", 0), sizes.get("#fields", 0)
    least = F.when(F.col("what") == 1, F.lit(rows * rule.floor)).otherwise(F.lit(fields * rule.floor))
    got = counts.where((F.col("what") > 0) & (F.col("n") >= least)).collect()
    return Corpus(rows, {r["word"]: r["n"] for r in got if r["what"] == 1}, frozenset(r["word"] for r in got if r["what"] == 2))


def weigher(stats: Corpus, rule: ResidueRule):
    """Inverse document frequency of a stem, the same for all below the floor; numbers weigh nothing."""
    n = max(stats.documents, 1)
    top = math.log(1 + 1 / rule.floor)
    known = {w: min(top, math.log(1 + n / d)) for w, d in stats.frequency.items()}
    known["#"] = 0.0
    get = known.get
    return lambda stem: get(stem, top)


class Judge:
    """Verdicts on texts, by one index and one corpus's statistics."""

    def __init__(self, index: ExemplarIndex, stats: Corpus, rule: ResidueRule = ResidueRule()):
        self.index, self.rule, self.names, self.weight = index, rule, stats.names, weigher(stats, rule)
        self.known: dict[str, tuple[str, float, float]] = {}

    def _word(self, token: str) -> tuple[str, float, float]:
        """Stem, weight, and weight if an example has it; remembered up to a bound."""
        if len(self.known) > 200_000:
            self.known.clear()
        s = self.index.of(token if token.isalpha() else _sign(token))
        w = self.weight(s)
        out = self.known[token] = s, w, w if s in self.index.vocabulary or token[0] == "x" else 0.0
        return out

    def possible(self, t: str) -> bool:
        """Whether the examples' words weigh enough in the text, furniture included, or it holds dummy Latin.

        Exact: a text whose windows reach both limits has such a share.
        """
        known, word = self.known, self._word
        found = [known.get(w) or word(w) for w in TOKEN.findall(without_tags(t).lower())]
        total = sum(x[1] for x in found)
        if sum(x[2] for x in found) >= min(self.rule.window, self.rule.document) * total - 1e-9:
            return True
        s = [x[0] for x in found]
        return len(found) > 3 and (not self.index.dummy.isdisjoint(zip(s, s[1:])) or any(a == b == c == d for a, b, c, d in zip(s, s[1:], s[2:], s[3:])))

    def __call__(self, text: str | None) -> tuple[str | None, float]:
        """``(kind, coverage)``: field, residue or null, and the share of the weight that residue windows hold."""
        if not text or not text.strip():
            return None, 0.0
        t = plain(text)
        index, rule = self.index, self.rule
        if index.field(t, self.names):
            return "field", 1.0
        if not self.possible(t):
            return None, 0.0
        cut = windows(t)
        seen = [index.nearest(w, self.weight, rule) for w in cut]
        latin = any(kind == "dummy" for _, _, kind in seen)
        covered = rest = 0.0
        for words, (own, at, kind) in zip(cut, seen):
            if latin and kind != "furniture":
                # dummy Latin is made up by every generator anew; its letters tell it, where most words have them
                like = at | {i for i, w in enumerate(words) if i not in at and dummy(w, index, rule)}
                at = like if sum(own[i] for i in like) >= rule.latin * sum(own) else at
            total, held = sum(own), sum(own[i] for i in at)
            residue = held >= rule.window * total
            if residue and kind == "furniture":
                continue
            covered += held if residue else 0.0
            rest += total - held if residue else total
        coverage = covered / (covered + rest) if covered else 0.0
        return ("residue" if coverage >= rule.document else None), coverage


def dummy(word: str, index: ExemplarIndex, rule: ResidueRule) -> bool:
    t = triples(word)
    return len(t & index.latin) >= rule.alike * len(t)


def judged(documents: DataFrame, rule: ResidueRule = ResidueRule(), exemplars: list[tuple[str, str]] = EXEMPLARS) -> DataFrame:
    """``doc_id, kind, coverage`` of the documents to leave out.

    ``kind`` is field (an unfilled template field stands where a value belongs)
    or residue (filler, error page or script notice make up the text).  Null,
    empty and blank texts are neither; texts are read whole, and no field or
    tag is too long to be one.  Statistics are counted over all documents.
    """
    index = ExemplarIndex(exemplars, rule.stem)
    stats = corpus(documents, index, rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(index, stats, rule)
        for batch in batches:
            out: list[list] = [[], [], []]
            for doc, text in zip(batch.column(0), batch.column(1)):
                kind, coverage = judge(text.as_py())
                if kind:
                    for c, x in zip(out, (doc.as_py(), kind, round(coverage, 6))):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["doc_id", "kind", "coverage"])

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, kind string, coverage double")
