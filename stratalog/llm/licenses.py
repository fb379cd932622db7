"""License scans with a positional rare-token index.

Templates are whole licence texts and notices with mandatory key phrases. The
index holds, for each template word, the templates and positions where it
stands. Of a file, the licence words are looked up by their inverse document
frequency over all documents, rarest first: each word's places in the file less
its position in a phrase are the places where the phrase could begin, the next
word's are intersected with them, and a phrase is there where all its words
agree, so every phrase that stands in a file is found. A template is there
if its mandatory phrases all are, in its order and about as far apart as in it.
How much of the whole template stands around that place, weighed by rarity, is
the score.

Most files lack a word of every phrase and are told so by one set comparison;
a word's places are looked up only for phrases whose words the file has.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column
from .license_texts import TEMPLATES, Template

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: A mandatory phrase may stand so many words, or this share of the template, away from its place in the template.
DRIFT, DRIFT_SHARE = 24, 0.25
#: A template of which some mandatory phrases are missing scores this much of the share that is there.
PARTLY = 0.5


def words_of(text: str | None) -> list[str]:
    """Lower-cased (A-Z) words of a whole text."""
    return WORD.findall((text or "").translate(LOWER)) if text and not text.isascii() else WORD.findall((text or "").lower())


class Phrase:
    """Words that must stand consecutively, and where they begin in their template."""

    def __init__(self, words: list[str], at: int = 0):
        self.words, self.at, self.need = words, at, frozenset(words)
        self.order: list[int] = []  # of its words, rarest first


class Index:
    """Postings of all template words with positions, rarest first by document frequencies."""

    def __init__(self, frequencies: dict[str, int], documents: int, phrases=PHRASES, templates: tuple[Template, ...] = TEMPLATES):
        rarity = lambda w: math.log((1 + documents) / (1 + frequencies.get(w, 0)))
        self.idf = {w: rarity(w) for w in vocabulary(phrases, templates)}
        self.base = [(Phrase(p.split()), label) for p, label in phrases.items()]
        self.templates: list[tuple[Template, list[str], list[Phrase], float]] = []
        for template in templates:
            words = words_of(template.text)
            found = [Phrase(p.split(), position(words, p.split())) for p in template.mandatory]
            self.templates.append((template, words, sorted(found, key=lambda p: p.at), sum(self.weight(w) for w in words)))
        #: by the rarest word of a phrase: (template, or -1 for a base phrase; phrase; label)
        self.postings: dict[str, list[tuple[int, Phrase, str]]] = defaultdict(list)
        for t, p, label in [*((-1, p, label) for p, label in self.base), *((t, p, x[0].label) for t, x in enumerate(self.templates) for p in x[2])]:
            p.order = sorted(range(len(p.words)), key=lambda i: (-self.idf[p.words[i]], i))
            self.postings[p.words[p.order[0]]].append((t, p, label))

    def weight(self, word: str) -> float:
        """A word that stands in every document still weighs a little, so that a template always has a weight."""
        return self.idf[word] + 0.01

    def starts(self, phrase: Phrase, places: dict[str, list[int]]) -> set[int]:
        """Where a phrase begins: places of its words by relative position, rarest first, intersected."""
        out: set[int] | None = None
        for i in phrase.order:
            begins = {at - i for at in places[phrase.words[i]]}
            out = begins if out is None else out & begins
            if not out:
                return set()
        return out or set()

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        held = set(words)
        asked = [x for w in sorted(held & self.postings.keys(), key=lambda w: (-self.idf[w], w)) for x in self.postings[w] if x[1].need <= held]
        starts: list[int] = []
        base_labels, found, score = set(), set(), 0.0
        if asked:
            wanted = set().union(*(p.need if t < 0 else self.templates[t][1] for t, p, _ in asked))
            places: dict[str, list[int]] = defaultdict(list)
            for i, w in enumerate(words):
                if w in wanted:
                    places[w].append(i)
            partly: dict[int, list[tuple[Phrase, set[int]]]] = defaultdict(list)
            for t, p, label in asked:
                at = self.starts(p, places)
                if at and t < 0:
                    starts += at
                    base_labels.add(label)
                elif at:
                    partly[t].append((p, at))
            for t, some in partly.items():
                value, whole = self._template(t, some, places)
                score = max(score, value)
                if whole:
                    found.add(self.templates[t][0].label)
        return {
            "n_words": len(words),
            "n_base": len(starts),
            "first_word": min(starts, default=None),
            "last_word": max(starts, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(base_labels | found)),
            "score": 1.0 if base_labels else min(1.0, score),
        }

    def _template(self, t: int, some: list[tuple[Phrase, set[int]]], places: dict[str, list[int]]) -> tuple[float, bool]:
        """(score, whether all mandatory phrases are there), at the best place."""
        _, words, phrases, total = self.templates[t]
        drift = max(DRIFT, int(DRIFT_SHARE * len(words)))
        begins = sorted((at - p.at, k) for k, (p, found) in enumerate(some) for at in found)  # where the template would begin
        best, whole, end = 0.0, False, 0
        there: Counter[int] = Counter()
        for begin, k in begins:  # the window of begins from this one to ``drift`` further
            while end < len(begins) and begins[end][0] <= begin + drift:
                there[begins[end][1]] += 1
                end += 1
            full = len(there) == len(phrases)
            whole |= full
            near = begin + drift // 2
            share = sum(self.weight(w) for i, w in enumerate(words) if stands(places.get(w, ()), i + near - drift, i + near + drift)) / total
            best = max(best, share if full else PARTLY * share * len(there) / len(phrases))
            if best >= 1 - 1e-9:
                break
            there[k] -= 1
            if not there[k]:
                del there[k]
        return best, whole


def stands(places: list[int], low: int, high: int) -> bool:
    """Whether one of the sorted places is in [low, high]."""
    at = bisect_left(places, low)
    return at < len(places) and places[at] <= high


def position(words: list[str], phrase: list[str]) -> int:
    """Where a phrase first stands in a template; raises ValueError if it doesn't."""
    for i in range(len(words) - len(phrase) + 1):
        if words[i : i + len(phrase)] == phrase:
            return i
    raise ValueError(f"not in its template: {' '.join(phrase)}")


def vocabulary(phrases=PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> set[str]:
    return {w for p in phrases for w in p.split()} | {w for t in templates for w in words_of(t.text)}


def frequencies(documents: DataFrame, text: str = "text", phrases=PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> tuple[dict[str, int], int]:
    """In how many documents each licence word stands, and how many documents there are; no larger than the templates' vocabulary."""
    known = vocabulary(phrases, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            seen[""] += batch.num_rows
            for value in batch.column(0):
                seen.update(known.intersection(words_of(value.as_py())))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    rows = documents.select(column(text).cast("string")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    return counts, counts.pop("", 0)


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan_licenses(documents: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row.

    A label is given where a base phrase stands, or all mandatory phrases of a
    template of that label stand together. ``score`` is 1 with a base phrase;
    else the largest share of a template, by rarity of its words, that stands
    where its mandatory phrases are, at most half of it if some are missing.

    A null text is empty: no words, empty labels, score 0. Repeated rows get
    equal results; an empty table gives an empty result. Only the two columns
    are read.
    """
    counts, total = frequencies(documents, text, phrases, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(counts, total, phrases, templates)
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            rows = [index.scan(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in rows], t) for n, t in zip(names, types)]], names=[key, *names])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(column(key), column(text).cast("string")).mapInArrow(run, f"`{key}` {kind}, {SCHEMA}")
