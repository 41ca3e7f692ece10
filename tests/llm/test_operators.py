"""Operators against plain versions, with nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import functools
import hashlib
import random
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from brute import base_counts, components, holds, shingles

from strandlog.llm import bpe, chat, decontam, licenses, lmscore, neardup, packing, quality, queries, records, sharding, shared, viterbi
from strandlog.llm.bpe import CachedTokenizer
from strandlog.llm.shared import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, id long, key string, size long, u long"


def word(rng):
    return "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7)))


@pytest.fixture(scope="module")
def corpus():
    """Texts with copies, near copies, shared passages and odd cases."""
    rng = random.Random(7)
    texts = [" ".join(word(rng) for _ in range(rng.randrange(3, 120))) for _ in range(40)]
    for base in (texts[3], texts[5], " ".join(word(rng) for _ in range(200))):
        texts += [base, base.upper(), base + " "]
        for _ in range(35):
            w = base.split()
            for _ in range(rng.randrange(1, 1 + max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = word(rng)
            texts.append(" ".join(w))
    passage = " ".join(word(rng) for _ in range(60))
    texts += [passage + " " + " ".join(word(rng) for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    texts += ["one two", "One  two", "a b c d", "a b c", "x\ny\nx\ny\nx\ny\n", "Zeile\x85eins\xa0zwei drei vier", " ".join(word(rng) for _ in range(30_000)), "# * $ % & | < >", "w" * 50_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(900, None), (901, ""), (902, " \n "), (None, texts[3]), (None, None), (903, texts[8]), (903, texts[8]), (904, texts[9]), (904, texts[10])]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, "en", "s", 0, "d", 1, "k", 2, 3) for i, t in corpus], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- op8


def test_near_duplicates_like_all_pairs(docs, corpus):
    want = components(corpus)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(corpus)
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] is None or r["doc_id"] == r["component_id"])
    by_id = {i: len(shingles(t)) for i, t in corpus}
    assert all(r["n_shingles"] == by_id[r["doc_id"]] for r in got if r["doc_id"] not in (None, 904))


def test_large_buckets_lose_no_link(docs, corpus, monkeypatch):
    monkeypatch.setattr(neardup, "SMALL", 2)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    want = components(corpus)
    assert all(r["component_id"] == want[r["doc_id"]] for r in neardup.near_duplicates(docs).where("doc_id IS NOT NULL").collect())


def test_one_of_each_group_stays(spark, docs, corpus):
    got = queries.keep_one_of_each(spark, docs, "")
    ids = [r["doc_id"] for r in got.collect()]
    want = components(corpus)
    assert sorted(i for i in ids if i is not None) == sorted({r for r in want.values()})
    assert got.columns == docs.columns and ids.count(None) == 2


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0


def test_registers_merge_and_estimate():
    from strandlog.llm import setsketch as S

    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = S.registers(x[:2000]), S.registers(x[400:2400])
    assert (S.merged(a, b) == S.registers(x[:2400])).all()
    got = S.similarity(a[None], b[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(got - 1600 / 2400) < 0.12


# ---- op6


def test_base_counts(docs, corpus):
    got = {r["doc_id"]: r for r in quality.judge(docs, None).collect()}
    for i, t in corpus:
        if i is not None and i != 904 and len(t or "") < 100_000:
            r, want = got[i], base_counts(t)
            assert [r[c] for c in quality.COUNTS] == want
            assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert r["kept"] == (not r["base_failed"])


def test_trees_separate_held_out_rows_and_keep_direction():
    from strandlog.llm.trees import fit

    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - 3 * x[:, 1] * (x[:, 2] > 0))))).astype(float)
    t = fit(x[:2000], y[:2000], np.array([1, -1, 0]))
    p = t.probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.75
    for j, way in ((0, 1), (1, -1)):
        grid = np.repeat(x[:50], 40, 0)
        grid[:, j] = np.tile(np.linspace(-3, 3, 40), 50)
        assert (np.diff(t.margin(grid).reshape(50, 40), axis=1) * way >= -1e-9).all()


def test_node_arrays_score_like_a_walk():
    from strandlog.llm.trees import fit

    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(500, 4)), rng.integers(0, 2, 500).astype(float)
    t = fit(x, y, np.zeros(4, int), rounds=5)

    def walk(row):
        out = t.base
        for n in t.roots:
            while t.feature[n] >= 0:
                n = t.left[n] + (row[t.feature[n]] > t.threshold[n])
            out += t.value[n]
        return out

    assert np.allclose(t.margin(x), [walk(r) for r in x])


def test_quality_on_labels(spark, sf):
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    verdict = {r["doc_id"]: r for r in quality.judge(d, quality.train(d, lab)).collect()}
    known = [(r["quality"], verdict[r["doc_id"]]) for r in lab.collect() if r["doc_id"] in verdict]
    passed = [(q, v["kept"]) for q, v in known if not v["base_failed"]]
    assert sum(bool(q) == k for q, k in passed) >= 0.9 * len(passed)


def test_quality_keeps_all_columns(docs, empty, spark):
    got = quality.keep(docs, None)
    assert got.schema == docs.schema and got.count() == quality.judge(docs, None).where("kept").count()
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(empty, labels) is None and quality.judge(empty, None).count() == 0


# ---- op9, op10


def path(name):
    return queries.vocabulary_file(name)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_tokens_are_whole_text_tokens(name, corpus, monkeypatch):
    rng = random.Random(3)
    odd = ["".join(rng.choice("aB 'st\n\t  .,1é́İΣς漢🙂 \u0085\x1c<|endoftext|>") for _ in range(rng.randrange(40))) for _ in range(3000)]
    texts = odd + [t for _, t in corpus if t]
    whole = plain_ids(name, texts)
    tok = CachedTokenizer(path(name))
    encode = lambda some: [x.tolist() for x in tok.encode(pa.array(some, pa.string()))]
    assert encode(texts) == whole
    tok.cache.entries = tok.plain_words.entries = 500
    assert [x for i in range(0, len(texts), 100) for x in encode(texts[i : i + 100])] == whole
    monkeypatch.setattr(bpe, "GROUP_BYTES", 300)
    assert encode(texts[2900:3050]) == whole[2900:3050] and encode([None, "", "a"])[:2] == [[], []] and encode([]) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_capitals_after_apostrophes(name):
    rng = random.Random(4)
    texts = ["O'Dónaill", "O'Súilleabháin", "CAFÉ'S", "Ñ'Tes", "ΑΣ'Σ ΟΔΟΣ", "É'RE'Ve'LLa'M"]
    texts += ["".join(rng.choice("aeÉñΣσß'''STDMdtsRrEeVvLl 1,") for _ in range(rng.randrange(40))) for _ in range(3000)]
    tok = CachedTokenizer(path(name))
    assert [x.tolist() for x in tok.encode(pa.array(texts))] == plain_ids(name, texts)


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path(name))


def plain_ids(name, texts):
    """By the library as it is."""
    return [e.ids for e in library(name).encode_batch(texts, add_special_tokens=False)]


def ids_of(name, text):
    return [*plain_ids(name, [text or ""])[0], 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(docs, corpus, empty, monkeypatch):
    got = packing.pack_documents(docs, path("word_bpe_49k.json")).collect()
    want = []
    for i, t in corpus:
        ids = ids_of("word_bpe_49k.json", t)
        want += [(i, p, a, len(ids[a : a + 2048]), crc(ids[a : a + 2048])) for p, a in enumerate(range(0, len(ids), 2048))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    seqs = {}
    for r in got:
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(seqs) <= -(-sum(r["length"] for r in got) // 2048) + 1
    monkeypatch.setattr(packing, "PART_ROWS", 3)  # several parts of a length
    again = packing.pack_documents(docs, path("word_bpe_49k.json")).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in again}) == len(got) and len({r["sequence_id"] for r in again}) == len(seqs)
    assert packing.pack_documents(empty, path("word_bpe_49k.json")).count() == 0


def test_packing_without_python_rows(spark, docs):
    # a table of a list of rows would start a second Python daemon on each executor
    packed = packing.pack_documents(docs, path("word_bpe_49k.json"))
    assert "ExistingRDD" not in packed._jdf.queryExecution().toString()


def test_packing_gives_memory_back(spark, corpus, monkeypatch):
    # small groups of its own, the same ids, and freed memory goes back after each batch
    texts = [t for _, t in corpus if t]
    tok, seen = CachedTokenizer(path("word_bpe_49k.json"), group_bytes=300), []
    group = tok.group
    monkeypatch.setattr(tok, "group", lambda some: seen.append(some.nbytes) or group(some))
    assert [x.tolist() for x in tok.encode(pa.array(texts))] == plain_ids("word_bpe_49k.json", texts) and len(seen) > 20
    runs = []
    frame = types.SimpleNamespace(sparkSession=spark, mapInArrow=lambda run, schema: runs.append(run))
    for trims, n in ((True, 4), (False, 1)):
        given = []
        shared.arrow(frame, lambda batches: iter(batches), "x long", trims=trims)
        monkeypatch.setattr(shared, "give_back", lambda: given.append(1))
        assert list(runs.pop()([1, 2, 3])) == [1, 2, 3] and len(given) == n


def test_plans_use_each_piece_once():
    rng = np.random.default_rng(4)
    for n in (0, 1, 7, 400, 5000):
        counts = np.bincount(rng.integers(1, 65, n), minlength=65)
        plan = packing.plan(counts, 64)
        used = np.zeros(65, int)
        for held, times in plan:
            assert sum(held) <= 64
            np.add.at(used, held, times)
        assert (used == counts).all()
    assert packing.fill(np.array([0, 2, 0, 1, 0, 0, 0, 0]), 5) == (3, 1, 1)


def test_records(spark, docs, corpus, empty, tmp_path):
    uri = f"file://{tmp_path}/rec"
    got = rows(records.encode_documents(docs, path("byte_bpe_50k.json"), uri, 3))
    at, want = 0, []
    known = {}
    for i, t in corpus:
        known.setdefault(i, []).append(ids_of("byte_bpe_50k.json", t))
    starts = {}
    got = [(i, *r) for i, *r in got]
    for i, start, n, c in sorted(got, key=lambda r: r[1]):
        assert start == at and (n, c) in {(len(x), crc(x)) for x in known[i]}
        starts.setdefault(i, []).append(start)
        at += n
    assert [i for i, *_ in sorted(got, key=lambda r: r[1])] == sorted((i for i, _ in corpus), key=lambda i: -1 if i is None else i)
    assert records.encode_documents(empty, path("byte_bpe_50k.json")).count() == 0
    # shuffled reads by the index, and damage
    name = sorted(p.name for p in (tmp_path / "rec").glob("*.rec"))[0]
    all_of = list(records.read_records(uri, name))
    order = np.random.default_rng(0).permutation(len(all_of))
    assert list(records.read_records(uri, name, order)) == [all_of[i] for i in order]
    assert list(records.read_records(uri, name, block=1)) == all_of
    data = bytearray((tmp_path / "rec" / name).read_bytes())
    data[20] ^= 1
    (tmp_path / "rec" / name).write_bytes(data)
    with pytest.raises(ValueError):
        list(records.read_records(uri, name))


# ---- op3


def test_shards(docs, corpus, empty):
    got = sharding.shard_documents(docs, 4, n_slots=64).collect()
    assert len(got) == len(corpus)
    loads = [sum(r["size"] for r in got if r["shard"] == s) for s in range(4)]
    assert sum(loads) == sum(len((t or "").encode()) + 1 for _, t in corpus)
    for s in range(4):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert {(r["doc_id"], r["text_crc32"]) for r in got} == {(i, zlib.crc32((t or "").encode())) for i, t in corpus}
    assert sharding.shard_documents(empty).count() == 0


def test_map_edits(spark, tmp_path):
    rng = np.random.default_rng(5)
    sizes = rng.lognormal(8, 1, 512).astype(np.int64)
    shards = sharding.first_map(512, 8)
    m = sharding.SlotMap(spark, f"file://{tmp_path}/map")
    m.store(0, shards)
    v = m.edit(0, sharding.rebalance(sizes, shards, 8))
    now = m.load(v)
    loads = np.bincount(now, weights=sizes)
    assert v == 1 and loads.max() - loads.min() < 0.001 * loads.mean() and (m.load(0) == shards).all()
    grown = now.copy()
    for slot, _, to in sharding.grow(sizes, now, 8):
        grown[slot] = to
    assert set(grown[grown != now]) == {8} and 0.8 < (grown == 8).dot(sizes) / (sizes.sum() / 9) < 1.2


# ---- op2


def test_counts_like_the_library(docs, corpus, empty):
    from tokenizers import Tokenizer, models, pre_tokenizers

    voc = viterbi.unigram_vocabulary(path("piece_bpe_32k.model"))
    tok = Tokenizer(models.Unigram(voc, 0, False))
    tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    c, rng = viterbi.Counter(voc), random.Random(0)
    texts = ["".join(rng.choice("ab  \n\x00漢字ñé𝔘▁xyz.日本🙂") for _ in range(rng.randrange(1, 60))) for _ in range(1500)] + [t for _, t in corpus if t and len(t) < 9000]
    assert [c.count(t)[1] for t in texts] == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    got = {r["doc_id"]: r["n_tokens"] for r in viterbi.token_counts(docs, path("piece_bpe_32k.model")).collect()}
    assert got[900] == got[901] == 0 and viterbi.token_counts(empty, path("piece_bpe_32k.model")).count() == 0


def test_counts_on_ties():
    from tokenizers import Tokenizer, models

    rng = random.Random(1)
    for _ in range(40):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(8)}
        voc = [("<unk>", 0.0), *((p, -float(rng.randrange(1, 4))) for p in sorted(pieces))]
        c, tok = viterbi.Counter(voc), Tokenizer(models.Unigram(voc, 0, False))
        for _ in range(30):
            t = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
            assert c.best(t)[1] == len(tok.encode(t).ids), (voc, t)


# ---- op1


def test_chat_digests(spark):
    control = queries.CONTROL_TEXT
    turns = [(1, 0, "user", "Hi"), (1, 1, "assistant", "a\nb"), (1, 2, "assistant", None), (2, 1, "tool", "<s>\\<s> [INST"), (2, 0, "system", "𝔘 <\\\\/s>"), (2, 2, "assistant", control), (2, 2, "assistant", control), (3, 0, None, ""), (-1, 0, "user", control), (-1, 1, "assistant", control)]
    df = spark.createDataFrame([(*t, 9, "x") for t in turns], "conv_id long, turn long, role string, text string, piece long, n_turns string")
    pieces = chat.formatted(chat.conversations(chat.records_of_rows(df)))
    got = {r["conv_id"]: r for r in chat.digests(pieces).collect()}
    for k in (1, 2, 3, -1):
        own = sorted((t for t in turns if t[0] == k), key=lambda t: (t[1], t[2] or "", t[3] or ""))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        r = got[k]
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        whole = "".join(p["piece"] for p in pieces.where(f"conv_id = {k}").orderBy("turn", "role", "text").collect())
        assert r["formatted_chars"] == len(whole)
        assert [(a, b) for a, b, _, _ in chat.read_back(whole)] == [(t[2] or "", t[3] or "") for t in own]
        assert all(chat.unescape(whole[a:b]) == t for _, t, a, b in chat.read_back(whole))
    assert chat.digests(chat.formatted(chat.conversations(chat.records_of_rows(df.limit(0))))).count() == 0


def test_layouts_become_turns(spark):
    recs = [
        ('{"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', [("user", "a"), ("assistant", "b")]),
        ('{"output": "b", "instruction": "a", "input": "x"}', [("user", "a\\n\\nx".replace("\\n", "\n")), ("assistant", "b")]),
        ('{"prompt": "a", "completion": null}', [("user", "a"), ("assistant", "")]),
        ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "c"}]}]}', [("user", "ac")]),
        ('{"system": "", "prompt": "a", "response": "b"}', [("user", "a"), ("assistant", "b")]),
        ('{"prompt": {"text": "a"}, "response": {"text": "b"}}', [("user", "a"), ("assistant", "b")]),
        ('{"messages": []}', []), ('{"id": 7, "prompt": "a", "completion": "b", "tags": ["x"]}', [("user", "a"), ("assistant", "b")]),
        ('{"messages": [{"role": "user", "content": "a", "name": "N"}, {"role": "assistant", "content": null}]}', [("user", "a"), ("assistant", "")]),
        ('{"conversations": null}', []), ('{"prompt": "a", "response": "b"}', [("user", "a"), ("assistant", "b")]),
    ]
    df = spark.createDataFrame([(str(i), r) for i, (r, _) in enumerate(recs)], "id string, record string")
    got = chat.turns_of_records(df).orderBy("id", "turn").collect()
    for i, (_, want) in enumerate(recs):
        assert [(r["role"], r["text"]) for r in got if r["id"] == str(i)] == want
    odd = spark.createDataFrame([("1", '{"odd": 1}'), ("2", None), ("3", '{"messages": [[1], {"x": 2}]}')], "id string, record string")
    assert chat.turns_of_records(odd, strict=False).count() == 0
    with pytest.raises(Exception, match="no mapping"):
        chat.turns_of_records(odd).collect()


# ---- op4


def test_contamination(spark, docs, empty):
    items = spark.createDataFrame([
        (1, "If Tom has 3 apples and 5 pears, then Tom eats 3 apples and walks 12 km to the old market square."),
        (2, "the quick brown fox jumps over the lazy dog while seven wizards mix ink"), (3, "short item here"), (4, None), (2, "the quick brown fox jumps over the lazy dog while seven wizards mix ink"),
    ], "item_id long, text string")
    filler = "nothing like that stands in this part of the text, which goes on for some words."
    cases = [
        (1, filler + " If Tom has 3 apples and 5 pears, then Tom eats 3 apples and walks 12 km to the old market square. " + filler, {1}),
        (2, filler + " if Anna has 7 apples and 9 pears, then Anna eats 7 apples and walks 4 miles to the old market square.", {1}),
        (3, filler + " if Anna has 7 apples and 9 pears, then Karl eats 8 apples and walks 4 miles to the old market square.", set()),
        (4, "THE QUICK  brown fox\njumps over the lazy dog, while seven wizards mix ink", {2}), (5, "a short item here too", {3}),
        (6, filler, set()), (7, None, set()), (8, "", set()), (9, "the quick brown fox jumps over nothing", set()), (None, "the quick brown fox jumps over the lazy dog while seven wizards mix ink", {2}),
    ]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in cases], "doc_id long, text string, item_id string, place int")
    got = rows(decontam.contaminated(d, items).select("doc_id", "item_id"))
    assert sorted(got, key=str) == sorted(((i, k) for i, _, ks in cases for k in ks), key=str)
    left = decontam.clean(d, items)
    assert left.columns == d.columns and {r["doc_id"] for r in left.collect()} == {i for i, _, ks in cases if not ks}
    assert decontam.contaminated(empty, items).count() == 0
    assert decontam.clean(docs, items.limit(0)).count() == docs.count()


def test_parts_of_items_and_changed_words(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghijk") for _ in range(9)) for _ in range(220)]
    long, short = words[:200], words[200:]
    table_of = ["".join(rng.choice("lmnopqrstu") for _ in range(9)) for _ in range(60)] + [str(200 + i) for i in range(16)]
    items = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(short)), (3, " ".join(table_of))], "item_id long, text string")
    changed = [*short[:9], "other", *short[10:]]
    cases = [
        (1, "so " + " ".join(long[80:100]) + " here", {1}), (2, "so " + " ".join(long[80:92]) + " here", set()), (3, " ".join(changed), {2}),
        (4, " ".join(short[:11]) + " and no more", set()), (5, " ".join(str(1000 + i) for i in range(16)), set()),
    ]
    d = spark.createDataFrame([(i, t) for i, t, _ in cases], "doc_id long, text string")
    got = rows(decontam.contaminated(d, items).select("doc_id", "item_id"))
    assert sorted(got) == sorted((i, k) for i, _, ks in cases for k in ks)



def test_names_that_open_sentences_and_repeated_ids(spark):
    asked = "Anna buys 12 apples. Anna gives 4 apples to Ben. How many apples does Anna have left?"
    asks = "Tom buys 7 apples. Tom gives 2 apples to Karl. How many apples does Tom have left?"
    letters = "James writes 3 letters to two friends every week. James mails them on Monday."
    items = spark.createDataFrame([(1, asked), (1, "seven other words stand in this second text of the item"), (2, letters), (2, letters), (None, asked)], "item_id long, text string")
    cases = [(1, asks, [1]), (2, asked.lower(), [1]), (3, asked.upper(), [1]), (4, letters.replace("James", "Peter").replace("3", "15"), [2]), (5, asks.replace("does Tom", "does Karl"), []), ((1 << 53) + 1, asked + " " + letters, [1, 2])]
    d = spark.createDataFrame([(i, t) for i, t, _ in cases] + [(None, "none")], "doc_id long, text string")
    got = rows(decontam.contaminated(d, items).select("doc_id", "item_id"))
    assert sorted(got) == sorted((i, k) for i, _, ks in cases for k in ks)


def test_contamination_like_every_alignment(spark):
    rng = random.Random(11)
    common = ["the", "of", "a", "and", "Tom", "Anna", "has", "12 km", "7", "3.5 hours", "went", "to", "Paris", "on", "with", "kg", "20%", "He", "if"]
    word = lambda: rng.choice(common) if rng.random() < 0.6 else "".join(rng.choice("abcde") for _ in range(4))
    items = [(i % 25, " ".join(word() for _ in range(rng.randrange(1, 40))) + ".") for i in range(30)]
    texts = []
    for _, t in items * 4:
        w = t.split(" ")
        lo = rng.randrange(len(w)) // 2
        w = w[lo : lo + rng.randrange(1, len(w) + 1)]
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join([*(word() for _ in range(rng.randrange(20))), *w, *(word() for _ in range(rng.randrange(20)))]))
    texts = [x.lower() if i % 9 == 0 else x.replace("Tom", "Carl").replace("12", "99") if i % 3 == 0 else x for i, x in enumerate(texts)]
    want = {(i, k) for i, t in enumerate(texts) for k, item in items if holds(t, item, decontam.VARIANTS)}
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = rows(decontam.contaminated(d, spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id"))
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_long_runs_of_names_and_numbers(spark):
    plain = "seven wizards mix ink while the brown fox jumps over the lazy dog"
    named = "so {} went home early that day with two old friends of theirs"
    items = spark.createDataFrame([(1, plain), (2, named.format("Anna Maria " * 3000))], "item_id long, text string")
    texts = [x + plain for x in ("Tom Karl " * 20000, "1," * 50000, "1" * 100000 + " ", "1..2,," * 20000, "." * 100000 + "5 km ", "X" + "a" * 100000 + "1 ")]
    d = spark.createDataFrame(list(enumerate([*texts, named.format("Tom Karl " * 20000)])), "doc_id long, text string")
    assert sorted(rows(decontam.contaminated(d, items).select("doc_id", "item_id"))) == [*((i, 1) for i in range(len(texts))), (len(texts), 2)]


# ---- op5


def test_license_scan(spark, docs, empty):
    index = licenses.Index()
    name, text = licenses.TEMPLATES[3]
    w = text.split()
    changed = " ".join(x for i, x in enumerate(w) if i not in (10, 11, 40)).replace("publish", "print and publish")
    for case, found in ((f"intro words {text} end", True), (f"Ünï {changed} end", True), (" ".join(w[:30]), False), ("Released under the mit LICENSE!", True), ("licensed under the", False), ("", False), (None, False)):
        got = [g for g in index.scan(case) if g[0] == "MIT"]
        assert bool(got) == found, case
        for _, cover, matched, lo, hi in got:
            assert 0 <= lo < hi <= len(case) and 0.8 <= cover <= 1
    (one,) = [g for g in index.scan(f"intro words {text} end") if g[0] == "MIT"]
    assert f"intro words {text} end"[one[3] : one[4]] == text.rstrip(".") and one[1] == 1
    assert len(index.scan("Released under the MIT License. x y z Released under the MIT License.")) == 2
    assert [g[0] for g in index.scan("x Licensed under the GNU General Public License, version 3. y")] == ["GPL-3.0"]
    assert licenses.license_scan(docs).count() == 0 and licenses.license_scan(empty).count() == 0


def test_inserted_words_and_the_whole_scan_by_brute_force(spark):
    rng = random.Random(6)
    index, texts, planted = licenses.Index(), [], []
    filler = lambda n: ["".join(rng.choice("qxzjk") for _ in range(5)) for _ in range(n)]
    for name, text in licenses.TEMPLATES:
        w = text.split()
        n = len(licenses._WORD.findall(text))
        for extra in range(31):
            if extra <= max(3, n // 2) and (not extra or n >= 10):  # a run of K + W - 1 words is left
                at = rng.randrange(len(w) + 1)
                texts.append(" ".join([*filler(rng.randrange(30)), *w[:at], *filler(extra), *w[at:], *filler(rng.randrange(30))]))
                planted.append((name, extra))
    long_one = max(licenses.TEMPLATES, key=lambda t: len(t[1]))
    texts += [" ".join([*filler(20_000), long_one[1], *filler(20_000), long_one[1]]), None, "", "the software is provided", " ".join(filler(500))]
    planted += [(long_one[0], 0)] + [None] * 4
    ids = [(1 << 53) + 2 * i + 1 for i in range(len(texts) - 1)] + [None]
    d = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)] + [(ids[0], texts[0], "x")], "doc_id long, text string, license string").repartition(3)
    got = licenses.license_scan(d).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for i, t, p in zip(ids, texts, planted):
        if p:
            assert any(r["license"] == p[0] and r["coverage"] == 1 for r in by_id[i]), p
        else:
            assert i not in by_id
    assert {r["n_spans"] for r in by_id[ids[-5]] if r["license"] == long_one[0]} == {2}
    assert len(by_id[ids[0]]) == 2 * len({r["license"] for r in by_id[ids[0]]})
    # every licence found is covered as said, and none is missed: each template against every place, by plain alignment
    for i, t in list(zip(ids, texts))[::25]:
        w = [x.lower() for x in licenses._WORD.findall(t or "")]
        if len(w) < 600:
            want = {}
            for name, text in licenses.TEMPLATES:
                own = [x.lower() for x in licenses._WORD.findall(text)]
                room = licenses.band_of(len(own))
                best = max(lcs(own, w[max(0, s - room) : s + len(own) + room]) for s in range(0, len(w), 1 + room // 2))
                want[name] = max(want.get(name, 0), best / len(own))
            for name, cover in {r["license"]: r["coverage"] for r in by_id.get(i, [])}.items():
                assert want[name] >= 0.8 and cover <= 1


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_a_wide_band_gives_the_full_alignment():
    rng = random.Random(2)
    for _ in range(200):
        t = [rng.randrange(1, 30) for _ in range(rng.randrange(4, 20))]
        d = [x for x in t if rng.random() > 0.1]
        for _ in range(rng.randrange(3)):
            d.insert(rng.randrange(len(d) + 1), 99)
        matched, lo, hi = licenses.aligned(np.array([0, 0, *d, 0]), np.array(t), 2, band=25)
        assert matched == lcs(t, d) and (not matched or 2 <= lo <= hi < len(d) + 2)


# ---- op7


def cross_entropy_by_hand(rows, good_ids):
    """(doc_id, n_tokens, target, background, score) of each row, one document after the other."""
    import math
    from collections import Counter

    import regex

    of = [(i, regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()), i in good_ids) for i, t in rows]

    def counted(chosen):
        word, gram, history = Counter(), Counter(), Counter()
        for w in chosen:
            word.update(w)
            gram.update(zip(["", *w], w))
            history.update(["", *w] if w else [])
        return word, gram, history

    whole, target = counted([w for _, w, _ in of]), counted([w for _, w, g in of if g])
    n_whole, n_target, size = sum(whole[0].values()), sum(target[0].values()), len(whole[0])
    out = []
    for i, w, is_good in of:
        own = counted([w])
        sums = []
        for (word, gram, history), n, leaves, r in ((target, n_target, is_good, 1.0), (whole, n_whole, True, n_target / n_whole if n_target else 1.0)):
            less = own if leaves else counted([])
            total = 0.0
            for h, x in zip(["", *w], w):
                p = (word[x] - less[0][x] + 1) / (n - len(w) * leaves + size)
                total -= math.log((r * (gram[h, x] - less[1][h, x]) + 50 * p) / (r * (history[h] - less[2][h]) + 50))
            sums.append(total / len(w) if w else None)
        out.append((i, len(w), *sums, sums[0] - sums[1] if w else None))
    return out


def same_scores(got, want):
    def order(r):
        return str(r[0]), r[1], *(round(x or 0, 6) for x in r[2:])

    assert len(got) == len(want)
    for x, y in zip(sorted(want, key=order), sorted(map(tuple, got), key=order), strict=True):
        assert x[:2] == y[:2] and x[2:] == pytest.approx(y[2:], abs=1e-9)


@pytest.mark.parametrize("small", [False, True])
def test_cross_entropy(spark, docs, corpus, empty, monkeypatch, small):
    if small:  # many chunks and buckets
        monkeypatch.setattr(lmscore, "CHUNK_BYTES", 3000)
        monkeypatch.setattr(lmscore, "BUCKET_ENTRIES", 2000)
    good = spark.createDataFrame([(i, 1) for i in range(0, 60)] + [(3, 1), (None, 1), (5000, 1)], "doc_id long, quality int")
    same_scores(lmscore.cross_entropy_difference(docs, good).collect(), cross_entropy_by_hand(corpus, set(range(60))))
    if not small:
        same_scores(lmscore.cross_entropy_difference(docs, good.limit(0)).collect(), cross_entropy_by_hand(corpus, set()))
        assert lmscore.cross_entropy_difference(empty, good).count() == 0


def test_cross_entropy_knows_all_words_and_bigrams(spark):
    """More words than any fixed vocabulary of 50,000: rare words keep counts of their own."""
    rng = random.Random(5)
    texts = [(i, " ".join(f"w{rng.randrange(60_000) if rng.random() < 0.8 else rng.randrange(40)}" for _ in range(2000))) for i in range(80)]
    texts += [(100, "Rare rare, twin"), (100, "rare"), (None, "w1 w2"), (101, "?"), (102, None)] + [(200 + i, f"only{i * 997 + j} only{i * 997 + j + 1}") for i in range(2) for j in range(400)]
    good = spark.createDataFrame([(i, 1) for i in [*range(20), 100, None]], "doc_id long, quality int")
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    same_scores(lmscore.cross_entropy_difference(docs, good).collect(), cross_entropy_by_hand(texts, {*range(20), 100}))


# ---- ids


IDS = [None, (1 << 53) + 1, (1 << 53) + 3, (1 << 63) - 1, 0, None]


@pytest.mark.parametrize("n", range(1, 11))
def test_ids_stay_whole_beside_nulls(spark, n):
    """No id turns into another one because a null stands in its batch."""
    body = "Permission granted. Released under the MIT License. "
    docs = spark.createDataFrame([(i, body + " ".join(f"{chr(97 + k)}{j}" for j in range(80))) for k, i in enumerate(IDS)], "doc_id long, text string").coalesce(1)
    items = spark.createDataFrame([(1, "Permission granted. Released under the MIT License.")], "item_id long, text string")
    labels = spark.createDataFrame([(IDS[1], 1)], "doc_id long, quality int")
    turns = docs.selectExpr("doc_id AS conv_id", "0L AS turn", "'user' AS role", "text")
    made = {
        1: lambda: chat.digests(chat.formatted(chat.conversations(chat.records_of_rows(turns)))).withColumnRenamed("conv_id", "doc_id"),
        2: lambda: viterbi.token_counts(docs, path("piece_bpe_32k.model")), 3: lambda: sharding.shard_documents(docs), 4: lambda: decontam.contaminated(docs, items), 5: lambda: licenses.license_scan(docs),
        6: lambda: quality.judge(docs, None), 7: lambda: lmscore.cross_entropy_difference(docs, labels), 8: lambda: neardup.near_duplicates(docs), 9: lambda: packing.pack_documents(docs, path("word_bpe_49k.json")), 10: lambda: records.encode_documents(docs, path("byte_bpe_50k.json")),
    }
    got = [r["doc_id"] for r in made[n]().select("doc_id").collect()]
    assert set(got) == set(IDS) and len(got) == (5 if n in (1, 4) else 6)
