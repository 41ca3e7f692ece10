"""Licence scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates are word sequences (ASCII letters and digits, lower case). Of each template the winnowed fingerprints of
its K-word grams (the least hash of every W neighbouring ones) make an inverted index, which finds any shared run of
K + W - 1 words. A document is looked up at every place; each hit names a template and a diagonal, that is where the
template would start. Diagonals of a template that lie together are one candidate: the document is aligned with the
template in a band around the first of them, with free ends in the document, and the words that match give the coverage
and the span. The band is as many words wide to either side as the template has, BAND at least, and the next candidate
starts half a band further, so words put in may move a notice by up to half its length (3 words at least) and it is still
found whole, if K + W - 1 of its words stand together.

The templates are a bounded list that travels with the code. Defined cases: a null or empty text has no match;
two notices of one licence are two spans; of overlapping spans the one with the most matched words stays, then the better
covered one, so that a notice isn't also taken for that of a sister licence; rows of one
id are scanned one by one, a null id stays null; templates shorter than a gram are refused; an empty table gives an
empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.license_templates import TEMPLATES
from strandlog.llm.shared import arrow, batch

K = 3
W = 3
BAND = 6
COVERAGE = 0.8
_WORD = re.compile(r"[A-Za-z0-9]+")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Index:
    """The inverted index of winnowed fingerprints: gram -> [(template, place)]."""

    def __init__(self, templates=None):
        self.names, self.vocabulary, self.templates = [], {}, []
        for name, text in templates or TEMPLATES:
            words = [w.lower() for w in _WORD.findall(text)]
            if len(words) < K:
                raise ValueError(f"template of {name} has under {K} words")
            self.names.append(name)
            self.templates.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64))
        self.base = len(self.vocabulary) + 1
        self.places: dict[int, list[tuple[int, int]]] = {}
        for t, ids in enumerate(self.templates):
            grams = self.grams(ids)
            hashes = _mixed(grams)
            picked = {i + int(hashes[i : i + W].argmin()) for i in range(max(1, len(grams) - W + 1))}
            for p in sorted(picked):
                self.places.setdefault(int(grams[p]), []).append((t, p))
        self.keys = np.array(sorted(self.places), np.int64)

    def grams(self, ids: np.ndarray) -> np.ndarray:
        if len(ids) < K:
            return np.empty(0, np.int64)
        out = np.zeros(len(ids) - K + 1, np.int64)
        for i in range(K):  # exact: base ** K fits
            out = out * self.base + ids[i : len(ids) - K + 1 + i]
        return out

    def ids(self, words: list[str]) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, 0) for w in words], np.int64)

    def hits(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, where it would start in the document) for every fingerprint found."""
        grams = self.grams(ids)
        if not len(grams):
            return []
        at = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        found = np.flatnonzero(self.keys[at] == grams)
        return sorted({(t, int(i) - p) for i in found for t, p in self.places[int(grams[i])]})

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(licence, coverage, matched words, start, end) with character spans, by place."""
        if not text or not self.hits(self.ids(_WORD.findall(text.lower()))):
            return []
        marks = list(_WORD.finditer(text))
        ids = self.ids([m[0].lower() for m in marks])
        found: list[tuple[int, float, int, int, str]] = []
        last: dict[int, int] = {}
        for t, start in self.hits(ids):  # by template, then by diagonal
            band = band_of(len(self.templates[t]))
            if t in last and start - last[t] <= band // 2:  # inside the band of the candidate before
                continue
            last[t] = start
            matched, lo, hi = aligned(ids, self.templates[t], start, band)
            cover = matched / len(self.templates[t])
            if cover >= COVERAGE:
                found.append((matched, cover, marks[lo].start(), marks[hi].end(), self.names[t]))
        out: list[tuple[str, float, int, int, int]] = []
        for matched, cover, lo, hi, name in sorted(found, key=lambda s: (-s[0], -s[1], s[2], s[4])):
            if all(hi <= r[3] or lo >= r[4] for r in out):
                out.append((name, cover, matched, lo, hi))
        return sorted(out, key=lambda r: (r[3], r[0]))


def band_of(n: int) -> int:
    return max(BAND, n)


def aligned(doc: np.ndarray, template: np.ndarray, start: int, band: int = BAND) -> tuple[int, int, int]:
    """Longest common subsequence of the template with the document, in a band around the diagonal that begins at
    `start`: matched words, and the first and last matched word of the document (of the most matches, the shortest span)."""
    lo, n = max(0, start - band), len(template)
    words = doc[lo : max(lo, start + n + band)]
    unit, at = len(words) + 1, np.arange(len(words))
    # best[j]: matches among the first j words, times unit, plus the first matched word, a later one being better
    best = np.zeros(unit, np.int64)
    diagonal = at + (lo - start)
    for i in range(n):
        hit = np.flatnonzero((words == template[i]) & (np.abs(diagonal - i) <= band))
        if len(hit):
            before = best[hit]
            best[hit + 1] = np.maximum(best[hit + 1], np.where(before >= unit, before + unit, unit + hit))
            np.maximum.accumulate(best, out=best)
    count = best // unit
    if not count[-1]:
        return 0, -1, -1
    ends = np.flatnonzero(count == count[-1])
    first = best[ends] % unit
    k = int((ends - first).argmin())
    return int(count[-1]), lo + int(first[k]), lo + int(ends[k]) - 1


FOUND = "doc_id long, license string, n_spans long, coverage double, matched_words long, spans array<struct<start: long, end: long>>"
_FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("n_spans", pa.int64()), ("coverage", pa.float64()), ("matched_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def license_scan(docs: DataFrame, templates=None) -> DataFrame:
    """One row per document and licence found: doc_id, license, n_spans, coverage (the best), matched_words, spans."""
    index = Index(templates)  # bounded by the templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                by: dict[str, list] = {}
                for name, cover, matched, lo, hi in index.scan(t):
                    by.setdefault(name, []).append((cover, matched, lo, hi))
                for name, s in by.items():
                    rows.append((k, name, len(s), max(x[0] for x in s), max(x[1] for x in s), [{"start": x[2], "end": x[3]} for x in s]))
            if rows:
                yield batch(_FOUND, *zip(*rows, strict=True))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, run, FOUND)
