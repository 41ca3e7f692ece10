"""Exact token ids by the tokenizers library, for whole groups of texts at a time.

Texts are cut at single spaces between characters that aren't white space, or at any space where the tokenizer drops
white space. For the tokenizers used here such a cut never falls inside a pre-token, so the ids of the parts, one after
the other, are the ids of the whole text. Arrow cuts a group of texts, numbers its distinct parts, and divides these into
a word of plain letters and the punctuation behind it; each distinct word is looked up in a bounded cache or given to the
library's model once, and numpy gathers the ids of the group. All other parts are cut by the tokenizer's own pre-token
pattern, and pieces that aren't plain words go through the whole library. Where other white space stands next to a
cut, the parts around it stay together; parts that normalisation could change beyond their case are encoded whole, and so
are texts with a special token's string, which the library takes out first.
tests/llm/test_operators.py holds both tokenizers against the plain library's ids of whole texts.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from strandlog.llm.shared import kept

#: Entries of a generation; a cache has two, the older one goes when the younger is full. Bounds a worker's memory.
CACHE_ENTRIES = 120_000
#: Longer parts are encoded but not kept.
CACHE_CHARS = 40
#: Texts are encoded in groups of about so many bytes; a longer text goes by stretches of it.
GROUP_BYTES = 4_000_000
#: The public byte-level pre-token pattern (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_CUT = regex.compile(r"(?<=\S) (?=\S)")
#: Letters of which each is composed and has one lower-case letter, by the same rule everywhere; and ASCII punctuation
#: other than the apostrophe, which may begin a pre-token of its own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-žΆΈ-ΊΌΎ-ΡΣ-ώЀ-џ"
_PLAIN = rf"^(?P<word>\n?[{_LETTERS}]+)(?P<tail>[!-&(-/:-@\[-`{{-~]*)$"


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet by its rule: printable Latin-1 stands for itself, other bytes count on from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class Cache:
    """A dict of two generations, so that frequent parts stay."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.entries, self.young, self.old = entries, {}, {}

    def missing(self, keys: list[str]) -> list[str]:
        """What must be made; of the rest, all are in young afterwards."""
        if len(self.young) > self.entries:
            self.young, self.old = {}, self.young
        young, old, new = self.young, self.old, []
        for k in keys:
            if k not in young:
                if k in old:
                    young[k] = old[k]
                else:
                    new.append(k)
        return new

    def keep(self, made: dict[str, bytes]) -> None:
        self.young.update((k, v) for k, v in made.items() if len(k) <= CACHE_CHARS)


class CachedTokenizer:
    def __init__(self, path: str, dtype: str = "<u4", entries: int = CACHE_ENTRIES, group_bytes: int | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.dtype, self.cache, self.plain_words = np.dtype(dtype), Cache(entries // 4), Cache(entries)
        self.most_bytes = group_bytes
        self.letters, self.code = byte_letters(), {2: "H", 4: "I"}[self.dtype.itemsize]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre = made["pre_tokenizer"]
        split = next((x for x in pre.get("pretokenizers", []) if x["type"] == "Split"), None)
        self.pattern = regex.compile(split["pattern"]["Regex"] if split else BYTE_LEVEL)
        self.lower = "Lowercase" in json.dumps(made["normalizer"])
        self.line_feed = 0 if self.lower else self.tok.encode("\n", add_special_tokens=False).ids[0]
        self.specials = [t["content"] for t in made["added_tokens"]]

    # ---- ids of parts

    def words(self, part: str) -> list[str]:
        """The part's pre-tokens; the part itself if normalisation may move their ends."""
        if self.lower:
            if part.isascii():
                part = part.lower()
            elif not unicodedata.is_normalized("NFC", part) or len(part.lower()) != len(part):
                return [part]
            else:  # by the library: str.lower() makes another letter of a last sigma
                part = self.tok.normalizer.normalize_str(part)
        return self.pattern.findall(part)

    def plain(self, piece: str) -> str | None:
        """The piece as the model takes it, if it is one pre-token; else None."""
        if not self.lower and (len(piece) == 1 or piece[1:].isalpha() and (piece[0] == " " or piece[0].isalpha())):
            return piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return None

    def ids_of_words(self, words: list[str]) -> list[bytes]:
        """The ids of words of plain letters, lower-cased ones where the tokenizer lowers: a word follows a space unless
        it starts with a line feed."""
        made, model, code, letters = {}, self.tok.model.tokenize, self.code, self.letters
        space = "" if self.lower else letters[32]
        for w in self.plain_words.missing(words):
            word = w if w.isascii() else w.encode("utf-8").decode("latin-1").translate(letters)
            ids = [t.id for t in model(word[1:])] if w[0] == "\n" else [t.id for t in model(space + word)]
            made[w] = array(code, [self.line_feed, *ids] if w[0] == "\n" else ids).tobytes()
        self.plain_words.keep(made)
        young = self.plain_words.young
        return [young[w] if w in young else made[w] for w in words]

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece, from the cache, the model or the library."""
        new = self.cache.missing(pieces)
        if new:
            made, rest, model, code = {}, [], self.tok.model.tokenize, self.code
            for p in new:
                word = self.plain(p)
                if word is None:
                    rest.append(p)
                else:
                    made[p] = array(code, [t.id for t in model(word)]).tobytes()
            if rest:
                cut = {p: self.words(p) for p in dict.fromkeys(rest)}
                whole = [p for p, ws in cut.items() if ws == [p]]
                for i in range(0, len(whole), 4096):
                    some = whole[i : i + 4096]
                    for p, e in zip(some, self.tok.encode_batch_fast(some, add_special_tokens=False), strict=True):
                        made[p] = array(code, e.ids).tobytes()
                inner = [w for p, ws in cut.items() if p not in made for w in ws]
                found = dict(zip(inner, self.ids_of(inner), strict=True)) if inner else {}
                made.update((p, b"".join([found[w] for w in ws])) for p, ws in cut.items() if p not in made)
            self.cache.keep(made)
            young = self.cache.young
            return [young[p] if p in young else made[p] if p in made else self.cache.old[p] for p in pieces]
        return list(map(self.cache.young.__getitem__, pieces))

    # ---- ids of texts

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, null being empty, in order; memory is bounded by the group's bytes and one text's ids."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return
        size, most = pc.binary_length(texts).to_numpy(), self.most_bytes or GROUP_BYTES
        odd = np.zeros(len(texts), bool)
        for s in self.specials:
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        alone = odd | (size > most)
        group = np.cumsum(size) // most
        starts = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | alone[1:] | alone[:-1]]))
        for lo, hi in zip(starts, [*starts[1:], len(texts)], strict=True):
            if odd[lo]:
                yield np.array(self.tok.encode(texts[int(lo)].as_py(), add_special_tokens=False).ids, self.dtype)
            elif alone[lo]:
                yield np.concatenate([x for part in stretches(texts[int(lo)].as_py(), most) for x in self.group(pa.array([part], pa.large_string()))])
            else:
                yield from self.group(texts.slice(lo, hi - lo))

    def group(self, texts: pa.Array) -> list[np.ndarray]:
        """encode() for texts without special tokens, all at once."""
        # a line feed is a cut, too; where white space counts, it starts the part behind it
        texts = pc.replace_substring(texts, "\n", " " if self.lower else " \n")
        cut = pc.split_pattern(texts, " ")
        first = cut.offsets.to_numpy()[:-1] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        code, parts = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        found = pc.extract_regex(parts, _PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(~plain)
        odd_parts = parts.take(pa.array(odd)).to_pylist()
        if self.lower:
            at, others, other = np.arange(len(code)), odd_parts, odd
        else:
            at, code, others, other = self.joined(code, first, odd, odd_parts, parts)
        # each distinct item is a word and its tail, or one of the others
        used = np.zeros(max(len(parts), int(other[-1]) + 1 if len(other) else 0), bool)
        used[code] = True
        rows = np.flatnonzero(used[: len(parts)] & plain)
        words = pc.struct_field(found, "word").take(pa.array(rows))
        words = (pc.utf8_lower(words) if self.lower else words).dictionary_encode()
        tails = pc.struct_field(found, "tail").take(pa.array(rows)).dictionary_encode()
        ids = self.ids_of_words(words.dictionary.to_pylist())
        n_words = len(ids)
        ids += self.ids_of(tails.dictionary.to_pylist())
        n_tails = len(ids)
        ids += [*self.ids_of(others), b""]
        segments = np.full((len(used), 2), len(ids) - 1)
        segments[rows, 0] = words.indices.to_numpy()
        segments[rows, 1] = n_words + tails.indices.to_numpy().astype(np.int64)
        segments[other, 0] = n_tails + np.arange(len(others))
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.dtype.itemsize
        flat, n_item = gathered(np.frombuffer(b"".join(ids), self.dtype), n, segments.ravel())
        n_item = n_item.reshape(-1, 2).sum(1)
        out, n = gathered(flat, n_item, code)
        upto = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(at, first)]
        return np.split(out, upto[1:])

    def joined(self, code: np.ndarray, first: np.ndarray, odd: np.ndarray, odd_parts: list[str], parts: pa.Array):
        """Where white space counts: items instead of parts. An item is a part that follows a space, or what stands
        first in a text, or parts that stay together, with the space before them. Gives the items' first parts, their
        codes, and the strings and codes of those that aren't single plain parts after a space."""
        open_start, open_end = np.zeros(len(parts), bool), np.zeros(len(parts), bool)
        bare = [p[1:] if p.startswith("\n") else p for p in odd_parts]
        open_start[odd] = np.fromiter((not p or p[0].isspace() for p in bare), bool, len(odd))
        open_end[odd] = np.fromiter((not p or p[-1].isspace() for p in odd_parts), bool, len(odd))
        leads = np.zeros(len(code), bool)
        leads[first] = True
        begins = leads.copy()
        begins[1:] |= ~(open_end[code[:-1]] | open_start[code[1:]])
        at = np.flatnonzero(begins)
        length = np.diff(at, append=len(code))
        special = leads[at] | (length > 1)
        item = code[at]
        strings = []
        for lead, i, n in zip(leads[at[special]].tolist(), at[special].tolist(), length[special].tolist(), strict=True):
            own = [parts[c].as_py() for c in code[i : i + n].tolist()]
            strings.append((("" if lead else " ") + " ".join(own)).replace(" \n", "\n"))
        distinct = {s: k for k, s in enumerate(dict.fromkeys(strings))}
        item[special] = len(parts) + np.fromiter((distinct[s] for s in strings), np.int64, len(strings))
        others = [*((" " + p).replace(" \n", "\n") for p in odd_parts), *distinct]
        return at, item, others, np.concatenate([odd, len(parts) + np.arange(len(distinct))])


def gathered(flat: np.ndarray, n: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What rows pick from the runs of flat, whose lengths are n: the picked runs one after the other, and their lengths."""
    begin, n = (np.cumsum(n) - n)[rows], n[rows]
    end = np.cumsum(n)
    return flat[np.repeat(begin - (end - n), n) + np.arange(end[-1] if len(end) else 0)], n


def stretches(text: str, group_bytes: int) -> Iterator[str]:
    """A long text in stretches that are cut where any part may be."""
    lo = 0
    while lo < len(text):
        cut = _CUT.search(text, lo + group_bytes // 2)
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def tokenizer(path: str, dtype: str = "<u4", entries: int = CACHE_ENTRIES, group_bytes: int | None = None) -> CachedTokenizer:
    """One for each worker process; it stays from task to task."""
    return kept(("tokenizer", path, dtype, entries, group_bytes), lambda: CachedTokenizer(path, dtype, entries, group_bytes))
