"""Quality rules: base rules on document statistics, then gradient-boosted trees over them.

Words are runs of characters other than space and 0x09-0x0D. A document fails the base rules with fewer than
MIN_WORDS words, or if over half of its words stand in three-word windows that occur twice or more. What passes is
scored by trees trained on a bounded sample of labelled documents (at most TRAIN_ROWS, those with the least id
hashes); they can only lower the score as symbols, repeated words or repeated lines grow (monotonic constraints).

Defined cases: a null or empty text has no words and fails; without labelled rows of both kinds the base rules
alone decide; labels of ids that aren't in the table, null labels and repeated labels (the least one counts) are
harmless; repeated rows are judged alike; all other columns pass through unchanged.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.shared import arrow
from strandlog.llm.trees import Trees, fit

MIN_WORDS = 50
#: At most so many labelled documents train the trees.
TRAIN_ROWS = 6000
#: Documents under this probability of good quality are rejected.
THRESHOLD = 0.3
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "short_share", "comma_rate", "stop_rate", "digit_share", "upper_share", "words_per_line"]
#: +1: more is never worse, -1: more is never better.
MONOTONE = {"symbol_share": -1, "repeat_share": -1, "dup_line_share": -1}


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    n, upto = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            n += i + 3 - max(i, upto)
            upto = i + 3
    return n


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the features of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # bytes split at exactly the ASCII white space that ends words here
    n = len(words)
    chars = len(text or "") - len(raw) + len(raw.translate(None, SPACES))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    if not n:
        return [0, 0, 0, 0, 0], [0.0] * len(FEATURES)
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    features = [
        np.log1p(n), chars / n, symbols / chars, dup / len(lines), repeat / n, len(set(words)) / n, sum(len(w) <= 2 for w in words) / n,
        raw.count(b",") / n, raw.count(b".") / n, digits / chars, upper / chars, n / len(lines),
    ]
    return [n, chars, symbols, dup, repeat], features


def base_failed(n_words, n_repeat_words):
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > 50 * n_words)


def measured(texts) -> tuple[np.ndarray, np.ndarray]:
    both = [statistics(t if isinstance(t, str) else None) for t in texts]
    return np.array([b[0] for b in both], np.int64).reshape(-1, len(COUNTS)), np.array([b[1] for b in both], float).reshape(-1, len(FEATURES))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Trees | None:
    """Trees fitted on at most `most` labelled documents; None if the labels have only one kind."""
    given = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").cast("int").alias("__y"))
    # a few more ids than needed, since some may not be in the table
    some = given.orderBy(F.xxhash64("__id"), "__id").limit(2 * most)
    rows = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("__text")).join(F.broadcast(some), "__id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, x = measured(b.column("__text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(pa.array(x[:, i]) for i in range(len(FEATURES))), b.column("__id"), b.column("__y"), pa.array(base_failed(counts[:, 0], counts[:, 4]))], names=[*FEATURES, "id", "y", "failed"])

    schema = ", ".join(f"{c} double" for c in FEATURES) + ", id long, y int, failed boolean"
    got = arrow(rows, measure, schema).where("NOT failed").orderBy(F.xxhash64("id"), *FEATURES).limit(most).toPandas()
    if got["y"].nunique() < 2:
        return None
    return fit(got[FEATURES].to_numpy(), got["y"].to_numpy(float), np.array([MONOTONE.get(f, 0) for f in FEATURES]))


def verdicts(texts, trees: Trees | None, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, base_failed and kept for each text."""
    counts, x = measured(texts)
    failed = base_failed(counts[:, 0], counts[:, 4])
    good = np.ones(len(counts), bool) if trees is None else trees.probability(x) >= threshold
    return counts, failed, ~failed & good


def judge(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its counts, whether the base rules reject it, and whether it is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, failed, kept = verdicts(b.column("text").to_pylist(), trees, threshold)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(counts[:, i]) for i in range(len(COUNTS))), pa.array(failed), pa.array(kept)], names=["doc_id", *COUNTS, "base_failed", "kept"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow(rows, run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean")


def keep(docs: DataFrame, trees: Trees | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that are kept, all columns as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(verdicts(b.column(at).to_pylist(), trees, threshold)[2]))

    at = docs.columns.index("text")
    return arrow(docs, run, docs.schema)
