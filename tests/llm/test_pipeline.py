"""The pipeline's stages, each on what the one before kept, against plain Python."""

import random
from collections import Counter

import public_tokenizers
import pytest

import corpus_pipeline
from keelson.llm import mixing, quality, sentencepiece_codec

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents():
    rng = random.Random(11)
    words = lambda n: [f"{rng.choice('abcdefgh')}{rng.choice(['on', 'er', 'ith', 'an'])}{rng.randrange(400)}" for _ in range(n)]
    rows, n = [], 0

    def add(text, lang="en", source="s1"):
        nonlocal n
        rows.append((n, text, lang, source, len(text or "")))
        n += 1

    for i in range(260):
        base = words(rng.randrange(55, 140))
        add(" ".join(base), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]))
        if i % 13 == 0:
            add(" ".join(base).upper())
        if i % 17 == 0:
            base[5] = "changed"
            add(" ".join(base), source="s2")
        if i % 31 == 0:
            add(" ".join(w + "&&&" for w in base))
    for text in (None, "", "too short", "one two three " * 40):
        add(text)
    rows.append(rows[3])
    rows.append((None, *rows[4][1:]))
    return rows


def lower(text):
    return text.encode().lower()


def near_sets(rows, k=5):
    out = []
    for r in rows:
        w = lower(r["text"]).split()
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))})
    return out


def test_stages(spark, documents, tmp_path):
    docs = spark.createDataFrame(documents, SCHEMA)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = docs.collect()
        docs = stage(spark, docs, str(tmp_path))
    last = docs.collect()
    names = [n for n, _ in corpus_pipeline.STAGES]

    # Quality: the verdicts of the operator, which is held against brute force by itself, take effect.
    verdicts = quality.judge(spark.read.parquet(str(tmp_path / names[0]))).where("kept").collect()
    assert Counter(r["doc_id"] for r in kept[names[1]]) == Counter(r["doc_id"] for r in verdicts) and len(verdicts) > 250
    assert not any("&&&" in r["text"] or len(r["text"].split()) < 50 for r in kept[names[1]])

    # Exact: the largest id of equal texts, once.
    best = {}
    for r in kept[names[1]]:
        key, rank = lower(r["text"]), (r["doc_id"] is not None, r["doc_id"] or 0)
        best[key] = max(best.get(key, (False, -1)), rank)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept[names[2]]) == sorted(best.values())

    # Near: the smallest id of each component.
    rows = kept[names[2]]
    sets = near_sets(rows)
    parent = list(range(len(rows)))

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in range(len(rows)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    smallest = {}
    for i, r in enumerate(rows):
        key = (r["doc_id"] is None, r["doc_id"] or 0)
        smallest[find(i)] = min(smallest.get(find(i), (True, 1 << 60)), key)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept[names[3]]) == sorted(smallest.values()) and len(rows) > len(smallest)

    # Mixing: as often as the schedule says; encoding: the codec's pieces of each.
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(spark.read.parquet(str(tmp_path / names[3]))).collect()}
    assert Counter(r["doc_id"] for r in kept[names[4]]) == Counter({i: n for i, n in copies.items() if n})
    codec = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    expected = Counter((r["doc_id"], r["lang"], r["source"], tuple(codec.encode(r["text"]))) for r in kept[names[4]])
    assert Counter((r["doc_id"], r["lang"], r["source"], tuple(r["pieces"])) for r in last) == expected and all(r["n_pieces"] == len(r["pieces"]) for r in last)


def test_run_and_extra_columns(spark, documents, tmp_path):
    some = [(*r, "x", 1) for r in documents[:40]]
    spark.createDataFrame(some, SCHEMA + ", kept string, size int").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "lang", "source", "n_pieces", "pieces"]
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0
