"""The pipeline's stages on a small fixture with planted copies and benchmark passages, against plain versions."""

import random

import pytest
from brute import base_counts, components, holds

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from strandlog.llm import decontam, quality  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijkl") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(rng.randrange(10, 40)).capitalize() + ".") for i in range(12)] + [(0, text(15)), (None, None)]
    texts = [text(rng.randrange(20, 400)) for _ in range(60)]
    near = texts[1].split()
    texts += [texts[0], texts[0].upper(), " ".join([*near[:5], "other", *near[6:]]), " ".join(near[:-3])]  # copies
    texts += [f"{text(60)} {items[i][1]} {text(40)}" for i in range(8)]  # benchmark passages
    texts += [f"{text(60)} {items[3][1].lower()} {text(90)}", "low quality " * 60, "short", "", None, " ".join(f"{w} #$%" for w in text(80).split())]
    texts += [text(3000), None, texts[5]]
    folder = tmp_path_factory.mktemp("pipeline")
    ids = [(1 << 53) + 2 * i + 1 for i in range(len(texts))]
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in zip(ids, texts)] + [(None, texts[2], "en", "s", 0), (ids[7], texts[7], "en", "s1", 0)]
    labels = [(i, int(k % 2), 0) for k, i in enumerate(ids)] + [(None, 1, 0)]
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return f"{folder}", docs, items


def test_stages_like_plain_versions(spark, folder):
    path, docs, items = folder
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near-duplicates", "benchmark decontamination", "packing"]
    read = spark.read.parquet(f"{path}/documents.parquet")
    trees = quality.train(read, spark.read.parquet(f"{path}/labels.parquet"))
    # quality rules: base rules one by one, trees on the same statistics
    good = []
    for d in docs:
        n, _, _, _, repeat = base_counts(d[1])
        if n >= 50 and 100 * repeat <= 50 * n and quality.verdicts([d[1]], trees)[2][0]:
            good.append(d)
    after = stages["quality rules"](spark, read, path)
    key = lambda d: (str(d[0]), str(d[1]), d[3])
    assert after.columns == read.columns and sorted(map(tuple, after.collect()), key=key) == sorted(good, key=key) and 20 < len(good) < len(docs)
    # near duplicates: of each group the least id; rows without an id stay
    roots, unique = components([d[:2] for d in good]), {}
    for d in good:
        if d[0] is not None and roots[d[0]] == d[0]:
            unique.setdefault(d[0], d)
    unique = [*unique.values(), *(d for d in good if d[0] is None)]
    after = stages["near-duplicates"](spark, spark.createDataFrame(good, SCHEMA), path)
    got = [tuple(r) for r in after.collect()]
    assert after.columns == read.columns and sorted(r[:2] for r in got if r[0] is not None) == sorted(d[:2] for d in unique if d[0] is not None) and len(got) == len(unique) < len(good)
    # benchmark decontamination
    clean = [d for d in unique if not any(k is not None and holds(d[1], t, decontam.VARIANTS) for k, t in items)]
    after = stages["benchmark decontamination"](spark, spark.createDataFrame(unique, SCHEMA), path)
    assert after.columns == read.columns and sorted(map(tuple, after.collect()), key=key) == sorted(clean, key=key) and len(clean) < len(unique)
    # packing, and the run from end to end
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in packed} == {d[0] for d in clean}
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def test_stages_of_nothing(spark, folder):
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder[0]).count() == 0
