"""SetSketch registers over word shingles.

With base B, each element has an exponentially distributed value for every register; a register keeps the least
one on the exponentially spaced scale floor(1 - log_B(value)), truncated to [0, Q + 1]. Registers merge by maximum,
and two registers agree with a probability that grows with the Jaccard similarity, so bands of registers are
locality-sensitive. The similarity itself is estimated by maximum likelihood from the numbers of registers that
are greater, less and equal, given both (exactly known) set sizes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

REGISTERS = 200
B = 1.001
A = 20.0
Q = 65_534
K = 4  # words of a shingle
_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)[:, None]
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: pa.Array, k: int = K) -> list[np.ndarray]:
    """64-bit hashes of the distinct shingles of each text, sorted; empty for null and texts without words."""
    texts = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    cut = pc.ascii_split_whitespace(texts)  # exactly 0x20 and 0x09-0x0D
    owner = np.repeat(np.arange(len(texts)), np.diff(cut.offsets.to_numpy()))
    words = cut.flatten()
    full = pc.greater(pc.binary_length(words), 0)
    owner, words = owner[full.to_numpy(zero_copy_only=False)], words.filter(full).dictionary_encode()
    known = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    h, n = known[words.indices.to_numpy()], np.bincount(owner, minlength=len(texts))

    def mix(h: np.ndarray, k: int, seed: int) -> np.ndarray:
        out = np.full(max(0, len(h) - k + 1), np.uint64(seed))
        for i in range(k):
            out = mixed(out * _P[i % 4] + h[i : len(h) - k + 1 + i])
        return out

    whole, out, at = mix(h, k, 0), [], 0
    for m in n.tolist():
        if m >= k:
            out.append(np.unique(whole[at : at + m - k + 1]))
        else:  # the whole sequence is one shingle
            out.append(mix(h[at : at + m], m, m) if m else np.empty(0, np.uint64))
        at += m
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The registers (u16) of a set of 64-bit hashes; all zero for the empty set."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 2048):
        np.minimum(least, (_MUL * x[None, i : i + 2048] + _ADD).min(1), out=least)
    value = -np.log1p(-(least.astype(float) + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(value) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merged(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.maximum(one, other)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def _slope(j, u, v, more, less, same):
    """Derivative of the log-likelihood of similarity j; u and v are the set sizes over their sum."""
    c = (B - 1) / B
    x, y = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    px, py = np.maximum(_p(x), 1e-300), np.maximum(_p(y), 1e-300)
    dx, dy = -v * c / ((1 - c * x) * np.log(B)), -u * c / ((1 - c * y) * np.log(B))
    return more * dx / px + less * dy / py + same * (-dx - dy) / np.maximum(1 - px - py, 1e-12)


def counts(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    more, less = (one > other).sum(-1), (one < other).sum(-1)
    return more, less, one.shape[-1] - more - less


def likely(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray, at_least: float) -> np.ndarray:
    """Whether the most likely similarity is at least `at_least`: the likelihood is concave, so its slope there tells."""
    u, v = n_one / (n_one + n_other), n_other / (n_one + n_other)
    most = np.minimum(u / v, v / u)
    return (most >= at_least) & (_slope(np.minimum(at_least, most * (1 - 1e-9)), u, v, *counts(one, other)) >= 0)


def similarity(one: np.ndarray, other: np.ndarray, n_one: np.ndarray, n_other: np.ndarray) -> np.ndarray:
    """The most likely similarity, by halving on the slope."""
    u, v = n_one / (n_one + n_other), n_other / (n_one + n_other)
    given = counts(one, other)
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(24):
        mid = (lo + hi) / 2
        up = _slope(mid, u, v, *given) >= 0
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    return (lo + hi) / 2
