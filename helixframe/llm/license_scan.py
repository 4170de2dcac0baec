"""Licence scan: a positional index of licence texts' rare words, aligned by relative position and verified by key phrases."""

from __future__ import annotations

import math
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import alnum_words, free_name, per_text, small_batches, table, utf8
from helixframe.llm.decontaminate import word_frequency
from helixframe.llm.licence_texts import PHRASES, TEMPLATES

#: IDF share of a template's words that must stand where an alignment puts them.
COVER = 0.6


def slack_of(template: list[bytes]) -> int:
    """Words that a place may be off: two, and one in 25 of a longer template, as wordings vary."""
    return 2 + len(template) // 25


@dataclass
class LicenceIndex:
    """Positions of each template's prefix words, which no match can do without.

    A match covers COVER of its template's IDF mass.  Of the template's words in the order of falling IDF, those that make up
    more than the rest of the mass can't all be missing: they are the ones that are looked up.
    """

    templates: list[tuple[str, list[bytes], list[list[bytes]]]]
    idf: dict[bytes, float]
    postings: dict[bytes, list[tuple[int, int]]]
    phrases: list[tuple[list[bytes], str]]

    @classmethod
    def build(cls, templates, phrases: dict[str, str], frequency: dict[bytes, int], docs: int) -> LicenceIndex:
        """frequency: in how many of the docs each template word occurs."""
        read = [(label, alnum_words(text.encode()), [alnum_words(p.encode()) for p in keys]) for label, text, keys in templates]
        idf = {w: math.log((docs + 1) / (frequency.get(w, 0) + 1)) + 1e-3 for _, words, _ in read for w in words}
        postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, (_, words, _) in enumerate(read):
            mass, total = 0.0, sum(map(idf.__getitem__, words))
            for w in sorted(set(words), key=lambda w: (-idf[w], w)):
                if mass > (1 - COVER) * total + 1e-9:
                    break
                at = [i for i, x in enumerate(words) if x == w]
                postings.setdefault(w, []).extend((t, i) for i in at)
                mass += len(at) * idf[w]
        return cls(read, idf, postings, [(alnum_words(p.encode()), label) for p, label in phrases.items()])

    def scan(self, text: bytes):
        """(words, base places (start, label), matches (label, start, end, cover))."""
        words = alnum_words(text)
        interest = self.idf.keys() | {w for p, _ in self.phrases for w in p}
        places: dict[bytes, list[int]] = {}
        if interest & set(words):
            for at, w in enumerate(words):
                if w in interest:
                    places.setdefault(w, []).append(at)
        base = sorted((at, label) for phrase, label in self.phrases for at in places.get(phrase[0], ()) if words[at : at + len(phrase)] == phrase)
        return words, base, self._align(words, places)

    def _align(self, words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[str, int, int, float]]:
        """The file's licence words, highest IDF first, propose where a template may start; each proposal is measured."""
        starts: dict[int, set[int]] = {}
        hopeless: set[int] = set()
        for w in sorted(places.keys() & self.postings.keys(), key=lambda w: (-self.idf[w], w)):
            for t, offset in self.postings[w]:
                template = self.templates[t][1]
                if t not in starts and t not in hopeless and sum(self.idf[x] for x in template if x in places) < COVER * sum(map(self.idf.__getitem__, template)) - 1e-9:
                    hopeless.add(t)
                if t not in hopeless:
                    d = slack_of(template)
                    starts.setdefault(t, set()).update(s for at in places[w] for s in range(at - offset - d, at - offset + d + 1))
        found = []
        for t in sorted(starts):
            found += self._matches(t, sorted(starts[t]), words, places)
        return found

    def _matches(self, t: int, starts: list[int], words: list[bytes], places: dict[bytes, list[int]]) -> list[tuple[str, int, int, float]]:
        """Of the starts that match, the best of each run whose gaps are within the slack; the earliest of equal ones."""
        label, template, keys = self.templates[t]
        slack = slack_of(template)
        runs: list[list[tuple[float, int]]] = []
        for start in starts:
            cover = self.cover(template, places, start)
            low, high = start - slack, start + len(template) + slack
            if cover >= COVER - 1e-9 and all(any(low <= at and words[at : at + len(k)] == k and at + len(k) <= high for at in places.get(k[0], ())) for k in keys):
                if not runs or start - runs[-1][-1][1] > slack:
                    runs.append([])
                runs[-1].append((cover, start))
        best = [max(run, key=lambda x: (round(x[0], 9), -x[1])) for run in runs]
        return [(label, max(0, s), min(len(words), s + len(template)), cover) for cover, s in best]

    def cover(self, template: list[bytes], places: dict[bytes, list[int]], start: int) -> float:
        """IDF share of the template's words that stand where the alignment puts them, give or take the slack."""
        got = total = 0.0
        slack = slack_of(template)
        for offset, w in enumerate(template):
            total += self.idf[w]
            at = places.get(w, ())
            i = bisect_left(at, start + offset - slack)
            if i < len(at) and at[i] <= start + offset + slack:
                got += self.idf[w]
        return got / total


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases: dict[str, str] | None = None, text_col: str = "text", name: str = "licence") -> DataFrame:
    """docs with a struct column <name>: n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    Words are runs of letters, digits and non-ASCII characters after lower-casing A-Z; n_base counts the places of the
    phrases, all of them; first_word and last_word are their least and largest start, null without any.  matches are
    alignments of templates (label, start, end, cover); labels has theirs and the base ones.  score is 1 with a base
    place, else the best cover.  Null and empty texts have no words, no label and score 0; words of equal IDF go by their
    bytes; rows are scanned one by one, so repeats don't matter, and an empty table gives an empty one.  If docs has a
    column <name>, underscores go in front of the new one's.

    IDF counts all rows; the index is as large as the templates, which are given, not gathered.
    """
    phrases = PHRASES if phrases is None else phrases
    vocabulary = {w for _, text, _ in templates for w in alnum_words(text.encode())}
    small_batches(docs)
    index = LicenceIndex.build(templates, phrases, word_frequency(docs, text_col, vocabulary), docs.count())
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def make():
        scan = shared.value.scan

        def one(text: bytes):
            words, base, found = scan(text)
            base_labels = sorted({label for _, label in base})
            labels = sorted({label for label, *_ in found} | set(base_labels))
            score = 1.0 if base else max((c for *_, c in found), default=0.0)
            matches = [{"label": a, "start": b, "end": c, "cover": d} for a, b, c, d in found]
            return len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, base_labels, labels, min(1.0, score), matches

        return one

    schema = "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, labels array<string>, score double, matches array<struct<label:string,start:int,end:int,cover:double>>"
    return docs.withColumn(free_name(docs, name), per_text(make, schema)(utf8(text_col)))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "licence.n_words", "licence.n_base", "licence.first_word", "licence.last_word", F.array_join("licence.base_labels", ",").alias("base_labels"), F.array_join("licence.labels", ",").alias("labels"), "licence.score")
