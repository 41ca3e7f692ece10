"""Cross-entropy difference: a target and a background bigram model over one vocabulary score each document.

Words (runs of letters and digits, lower-cased letter by letter) of all documents are the vocabulary of both models, and
every bigram is counted under its own two words, so what is gathered grows with the corpus. Both models smooth alike:

    p(w | h) = (r c(h, w) + MU p(w)) / (r c(h) + MU),    p(w) = (c(w) + 1) / (all words + size of vocabulary)

The background counts all documents, the target those labelled good; r matches the background to the target's size (the
share of the target's words; 1 for the target itself and where there is no target). A document is scored by what the
*others* hold: its own words and bigrams are left out of every count. A token's loss is -ln p; the score is the mean
over a document's tokens of target loss less background loss: the lower, the more like the target.

1. Documents are tokenised once, in chunks of about CHUNK_BYTES; a chunk is a row of a written table: the hashes of its
   words, and each token as a number among them.
2. A chunk sends each word and each bigram that it holds once, with its counts, to the bucket of its 64-bit hash. So no
   word, bigram or copied document makes a bucket larger than others, and buckets are as many as the corpus needs.
3. A bucket adds up its counts and sends the totals back to the chunks that asked, in the order they asked. A chunk then
   has all that its documents need.

Words and bigrams are told apart by 64-bit hashes: of 10^12 different ones some 10^4 pairs would share counts.

Defined cases: a null text or one without words has 0 tokens and null losses; without target documents the target
model is the uniform one; labels that are null, repeated or of unknown ids don't matter; rows of one id are scored one by
one, and one row's twin counts as another document; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.bpe import gathered
from strandlog.llm.shared import arrow, batch, checked_broadcast, forget, give_back, written

MU = 50.0
#: Text of a chunk; a longer document is a chunk of its own.
CHUNK_BYTES = 4 << 20
#: Counts that a bucket gets, about.
BUCKET_ENTRIES = 500_000
WORD, GRAM = 0, 1
#: Odd multipliers of the hash of a bigram.
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
CHUNKS = "chunk long, doc_id array<long>, good array<boolean>, n array<int>, words binary, tokens binary"
_CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("good", pa.list_(pa.bool_())), ("n", pa.list_(pa.int32())), ("words", pa.binary()), ("tokens", pa.binary())])
BLOCKS = "kind int, bucket int, chunk long, hashes binary, n binary, n_good binary"
_BLOCKS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("n", pa.binary()), ("n_good", pa.binary())])
TOTALS = "kind int, bucket int, chunk long, distinct long, n binary, n_good binary"
_TOTALS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("chunk", pa.int64()), ("distinct", pa.int64()), ("n", pa.binary()), ("n_good", pa.binary())])
SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
_SCORES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("target_loss", pa.float64()), ("background_loss", pa.float64()), ("score", pa.float64())])


def packed(numbers: np.ndarray) -> bytes:
    """Small numbers as bytes: those of one weight together, compressed. Most counts are 1, so they take next to nothing."""
    return pa.compress(np.ascontiguousarray(numbers.astype("<u8").view("u1").reshape(-1, 8).T), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int) -> np.ndarray:
    planes = pa.decompress(data, decompressed_size=8 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, "u1").reshape(8, n).T).view("<i8").ravel()


def tokenized(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words, each token's place among them, and the number of tokens of each text."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    sizes = np.diff(cut.offsets.to_numpy())
    parts = cut.flatten().dictionary_encode()
    # words of the distinct parts only
    inner = pc.split_pattern_regex(pc.utf8_lower(parts.dictionary), r"[^\p{L}\p{N}]+")
    n_inner = np.diff(inner.offsets.to_numpy())
    words = inner.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(n_inner)), n_inner)[full]
    n_inner = np.bincount(owner, minlength=len(n_inner))
    words = words.filter(pa.array(full)).dictionary_encode()
    tokens, n_part = gathered(words.indices.to_numpy(), n_inner, parts.indices.to_numpy().astype(np.int64))
    n = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights=n_part, minlength=len(sizes)).astype(np.int32)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    return hashes, tokens, n


def chunks(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, good) as chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def made() -> pa.RecordBatch:
            ids, texts, good = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
            words, tokens, n = tokenized(texts)
            return batch(_CHUNKS, [number], [ids.to_pylist()], [good.to_pylist()], [n], [words.tobytes()], [packed(tokens)])

        for b in batches:
            held.append(b)
            size += b.column(1).nbytes
            if size >= CHUNK_BYTES:
                yield made()
                number, held, size = number + 1, [], 0
        if held:
            yield made()

    return arrow(docs, run, CHUNKS)


class Chunk:
    """A chunk's documents as arrays: its keys are its words and bigrams, each set ordered by bucket."""

    def __init__(self, row: dict, n_buckets: int):
        self.ids, self.n = row["doc_id"], np.array(row["n"], np.int64)
        self.good = np.array(row["good"], bool)
        words = np.frombuffer(row["words"], np.uint64)
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.word = unpacked(row["tokens"], int(self.n.sum()))
        self.starts = np.zeros(len(self.word), bool)
        self.starts[(np.cumsum(self.n) - self.n)[self.n > 0]] = True
        self.history = np.concatenate([[0], self.word[:-1]])  # where a text doesn't start
        before = np.where(self.starts, np.uint64(0), words[self.history] if len(words) else np.uint64(0))
        x = (before ^ (before >> np.uint64(29))) * _P[0] + words[self.word]
        x = (x ^ (x >> np.uint64(32))) * _P[1]
        gram = pa.array(x ^ (x >> np.uint64(29))).dictionary_encode()
        self.gram = gram.indices.to_numpy().astype(np.int64)
        self.keys = {WORD: words, GRAM: gram.dictionary.to_numpy()}
        self.bucket = {k: ((h >> np.uint64(16)) % np.uint64(n_buckets)).astype(np.int32) for k, h in self.keys.items()}
        self.order = {k: np.argsort(b, kind="stable") for k, b in self.bucket.items()}

    def of(self, kind: int) -> np.ndarray:
        return self.word if kind == WORD else self.gram

    def blocks(self) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
        """(kind, bucket, hashes, counts, counts in good documents) of all keys."""
        good = self.good[self.doc]
        for kind, keys in self.keys.items():
            order, code = self.order[kind], self.of(kind)
            n, n_good = (np.bincount(c, minlength=len(keys))[order] for c in (code, code[good]))
            bucket, keys = self.bucket[kind][order], keys[order]
            edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                yield kind, int(bucket[lo]), keys[lo:hi].tobytes(), packed(n[lo:hi]), packed(n_good[lo:hi])

    def own(self, kind: int) -> np.ndarray:
        """For each token: how often its document has its word or bigram."""
        code = self.of(kind)
        pair = pa.array(self.doc * max(1, len(self.keys[kind])) + code).dictionary_encode().indices.to_numpy()
        return np.bincount(pair)[pair] if len(pair) else np.zeros(0, np.int64)


def blocks(chunked: DataFrame, n_buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in (b.slice(i, 1).to_pylist()[0] for i in range(b.num_rows)):
                found = list(Chunk(row, n_buckets).blocks())
                for i in range(0, len(found), 256):
                    kind, bucket, *rest = zip(*found[i : i + 256], strict=True)
                    yield batch(_BLOCKS, kind, bucket, [row["chunk"]] * len(kind), *rest)

    return arrow(chunked, run, BLOCKS)


def totals(sent: DataFrame) -> DataFrame:
    """The totals of each block's keys, in their order; `distinct` is a bucket's number of keys, on one of its rows."""

    def add_up(table: pa.Table) -> pa.Table:
        sizes = [len(x) // 8 for x in table["hashes"].to_pylist()]
        keys = pa.array(np.frombuffer(b"".join(table["hashes"].to_pylist()), np.uint64)).dictionary_encode()
        code, cuts, out = keys.indices.to_numpy(), np.cumsum(sizes)[:-1], []
        for c in ("n", "n_good"):
            given = np.concatenate([unpacked(x, n) for x, n in zip(table[c].to_pylist(), sizes, strict=True)])
            total = np.bincount(code, weights=given, minlength=len(keys.dictionary)).astype(np.int64)
            out.append([packed(x) for x in np.split(total[code], cuts)])
        distinct = [len(keys.dictionary)] + [0] * (len(sizes) - 1)
        give_back()
        return pa.table([table["kind"], table["bucket"], table["chunk"], pa.array(distinct, pa.int64()), *(pa.array(x, pa.binary()) for x in out)], schema=_TOTALS)

    return sent.groupBy("kind", "bucket").applyInArrow(add_up, TOTALS)


def losses(chunk: Chunk, n: dict[int, np.ndarray], n_good: dict[int, np.ndarray], corpus: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Of each token, by the counts of the other documents: target and background loss. corpus: words, good, vocabulary,
    texts (that have words), good_texts."""
    own = {k: chunk.own(k) for k in (WORD, GRAM)}
    good = chunk.good[chunk.doc]
    own_history = np.where(chunk.starts, 1, 0)
    # how often the document has a token's history: that of the token before
    own_history[~chunk.starts] = own[WORD][np.flatnonzero(~chunk.starts) - 1]
    length = chunk.n[chunk.doc]
    out = []
    for counts, whole, texts, out_of, r in (
        (n_good, corpus["good"], corpus["good_texts"], good, 1.0),
        (n, corpus["words"], corpus["texts"], np.ones(len(good), bool), corpus["good"] / corpus["words"] if corpus["good"] else 1.0),
    ):
        word, gram = (counts[k][chunk.of(k)] - own[k] * out_of for k in (WORD, GRAM))
        history = np.where(chunk.starts, texts, counts[WORD][chunk.history] if len(counts[WORD]) else 0) - own_history * out_of
        p = (word + 1) / (whole - length * out_of + corpus["vocabulary"])
        out.append(np.log(r * history + MU) - np.log(r * gram + MU * p))
    return out[0], out[1]


def scored(chunked: DataFrame, found: DataFrame, n_buckets: int, corpus: dict[str, int]) -> DataFrame:
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for i in range(left.num_rows):
            c = Chunk(left.slice(i, 1).to_pylist()[0], n_buckets)
            counts = {x: {} for x in ("n", "n_good")}
            for kind in (WORD, GRAM):
                own = right.filter(pc.equal(right["kind"], kind)).sort_by("bucket")
                sizes = np.bincount(c.bucket[kind], minlength=n_buckets)[own["bucket"].to_numpy()].tolist()
                for x in counts:
                    counts[x][kind] = np.empty(len(c.keys[kind]), np.int64)
                    if sizes:
                        counts[x][kind][c.order[kind]] = np.concatenate([unpacked(d, n) for d, n in zip(own[x].to_pylist(), sizes, strict=True)])
            target, background = losses(c, counts["n"], counts["n_good"], corpus)
            n = np.where(c.n, c.n, 1)
            means = [np.bincount(c.doc, weights=x, minlength=len(c.n)) / n for x in (target, background, target - background)]
            parts.append(batch(_SCORES, c.ids, c.n, *(pa.array(m, mask=c.n == 0) for m in means)))
        give_back()
        return pa.Table.from_batches(parts, schema=_SCORES)

    return chunked.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(score, SCORES)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, target_loss, background_loss (means), score."""
    ids = target_ids.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("good", F.lit(True))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(checked_broadcast(ids), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    chunked = written(chunks(rows), "chunks")
    each = chunked.select(F.explode(F.arrays_zip("n", "good")).alias("x")).select("x.*")
    good = F.col("good").cast("int")
    sums = each.agg(F.sum("n"), F.sum(F.col("n") * good), F.sum((F.col("n") > 0).cast("int")), F.sum((F.col("n") > 0).cast("int") * good)).first()
    corpus = dict(zip(("words", "good", "texts", "good_texts"), (int(x or 0) for x in sums), strict=True))
    n_buckets = max(1, -(-2 * corpus["words"] // BUCKET_ENTRIES))
    found = written(totals(blocks(chunked, n_buckets)), "totals")
    corpus["vocabulary"] = int(found.where(F.col("kind") == WORD).agg(F.sum("distinct")).first()[0] or 0)
    out = written(scored(chunked, found, n_buckets, corpus), "scores")
    forget(chunked)
    forget(found)
    return out
