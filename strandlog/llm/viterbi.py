"""Count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton gives every vocabulary piece that ends at a place, longest first; dynamic programming
carries the best score and its number of pieces from place to place, and no piece is ever made. Ties go by the
tokenizers library's unigram rule: of equal scores the one whose last piece starts first stays. A character that
no piece covers costs the least score less 10, and a run of such characters counts as one piece.

The text is prepared as that library's Metaspace does it: spaces become U+2581, one stands in front, and a word
starts at each. Words are independent, so counts of words met before come from a bounded cache.

Defined cases: a null or empty text has no piece; a text of any length is split into words, and a word of any
length takes memory in proportion; repeated rows are counted alike; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.bpe import Cache
from strandlog.llm.shared import arrow, kept

SPACE = "▁"
UNKNOWN = "<unk>"
#: Score that an unknown character has below the least one (fixed value of the tokenizer).
UNKNOWN_PENALTY = 10.0
#: Words of a generation of a worker's cache, which has two; frequent words stay.
CACHE_ENTRIES = 300_000


def unigram_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """(piece, log-probability) of a public piece vocabulary: the unknown piece first, then Zipf's law over the ranks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    special = lambda i: model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not special(i)]
    whole = sum(1 / r for r in range(1, len(pieces) + 1))
    return [(UNKNOWN, 0.0), *((p, -math.log(r * whole)) for r, p in enumerate(pieces, 1))]


class Counter:
    """Counts pieces of words by dynamic programming over the matches."""

    def __init__(self, vocabulary: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary[1:]:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocabulary) - UNKNOWN_PENALTY
        self.cache = Cache(CACHE_ENTRIES)

    def best(self, word: str) -> tuple[float, int]:
        """Score and number of pieces of the best segmentation of a word."""
        n = len(word)
        score, pieces, open_run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        reached = 0  # places up to here are final

        def bridge(upto: int, covered: bool) -> None:
            # places without a match that ends there, or where only the unknown character does
            nonlocal reached
            for e in range(reached + 1, upto + (not covered)):
                score[e] = score[e - 1] + self.unknown
                pieces[e] = pieces[e - 1] + (not open_run[e - 1])
                open_run[e] = True
                reached = e

        ends: dict[int, list[tuple[int, float]]] = {}
        for last, found in self.automaton.iter(word):
            ends.setdefault(last + 1, []).append(found)
        for e in sorted(ends):
            bridge(e, True)
            best, start, single = None, 0, False
            for length, s in ends[e]:  # longest first: the earliest start stays on ties
                total = score[e - length] + s
                single |= length == 1
                if best is None or total > best:
                    best, start = total, e - length
            unknown = False
            if not single and score[e - 1] + self.unknown > best:
                best, start, unknown = score[e - 1] + self.unknown, e - 1, True
            score[e] = best
            pieces[e] = pieces[start] + (not (unknown and open_run[start]))
            open_run[e] = unknown
            reached = e
        bridge(n, False)
        return score[n], pieces[n]

    def count(self, text: str) -> tuple[float, int, int]:
        """Score, pieces and words of a whole text."""
        if not text:
            return 0.0, 0, 0
        marked = text.replace(" ", SPACE)
        words = (marked if marked.startswith(SPACE) else SPACE + marked).split(SPACE)[1:]
        made = {w: self.best(SPACE + w) for w in dict.fromkeys(self.cache.missing(words))}
        self.cache.keep(made)
        known = self.cache.young
        found = [known[w] if w in known else made[w] for w in words]
        return sum([f[0] for f in found]), sum([f[1] for f in found]), len(words)


def counter(model_path: str) -> Counter:
    return kept(("viterbi", model_path), lambda: Counter(unigram_vocabulary(model_path)))


def token_counts(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, n_words and the best segmentation's score for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model_path)
        for b in batches:
            score, pieces, words = zip(*(c.count(t or "") for t in b.column("text").to_pylist()), strict=True) if b.num_rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pieces, pa.int64()), pa.array(words, pa.int64()), pa.array(score, pa.float64())], names=["doc_id", "n_tokens", "n_words", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, run, "doc_id long, n_tokens long, n_words long, score double", keeps=True)
