"""Near-duplicates, components, fuzzy passages, suffix sorting and repeated substrings, against brute force."""

import contextlib
import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import _common, components, near_dedup, passage_chains, suffix_dedup, suffix_sort

DOCS = "doc_id long, text string, id int, row int, anchor string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], DOCS)


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def changed(rng, text, n):
    out = list(text)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"c{rng.randrange(10**6)}"
    return out


# -- Near-duplicates ------------------------------------------------------------------------------------------------------


def union_find(edges, items):
    parent = {i: i for i in items}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in items}


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL", local)
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (7, 9), (9, 7)]
    got = [(r["id"], r["component"]) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(got) == len(dict(got))
    items = {x for e in edges for x in e}
    assert {i: dict(got).get(i, i) for i in items} == union_find(edges, items)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_sets(rows, k):
    out = {}
    for n, (_, text) in enumerate(rows):
        w = tuple((text or "").encode().lower().split())
        out[n] = frozenset(w[i : i + k] for i in range(max(1, len(w) - k + 1))) if w else frozenset()
    return out


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(7)
    rows, n = [], 0
    passage = words(rng, 60)
    for group in range(25):
        base = words(rng, rng.randrange(30, 200))
        for k in range(rng.randrange(1, 5)):
            rows.append((n, " ".join(changed(rng, base, k * rng.randrange(0, 3)))))
            n += 1
    family = words(rng, 120)
    rows += [(n + i, " ".join(changed(rng, family, 1 + i % 4))) for i in range(90)]
    n += 90
    rows += [(n + i, " ".join(words(rng, 20) + passage + words(rng, 15))) for i in range(60)]
    n += 60
    rows += [(n, "Same Text here now ok"), (n + 1, "same text HERE now ok"), (n + 1, "same text HERE now ok"), (n + 2, "two words"), (n + 3, "two words"), (n + 4, None), (n + 5, ""), (n + 6, " \n"), (None, "same text here now ok")]
    return rows


def test_near_duplicates(spark, near_rows, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 8)  # so that nodes branch
    out = near_dedup.near_duplicates(docs(spark, near_rows), k=4).collect()
    sets = shingle_sets(near_rows, 4)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    of = union_find(links, sets)
    smallest = defaultdict(list)
    for n, top in of.items():
        smallest[top].append(near_rows[n][0])
    expected = Counter()
    for n, top in of.items():
        ids = [i for i in smallest[top] if i is not None]
        component = near_rows[n][0] if not sets[n] else min(ids, default=None)
        expected[(near_rows[n][0], len(sets[n]), component, near_rows[n][0] == component)] += 1
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out) == expected
    stays = Counter(r["component_id"] for r in out if r["stays"] and r["n_shingles"])
    assert set(stays.values()) == {1} and len(stays) == len({t for n, t in of.items() if sets[n]})


def test_near_large_families(spark, near_rows, monkeypatch):
    """Families too large for one group, and too heavy ones, give the same links."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    monkeypatch.setattr(near_dedup, "CONTRACT", 2)
    monkeypatch.setattr(near_dedup, "HOT_NODES", 50)
    few = near_rows[-140:]
    sets = shingle_sets(few, 4)
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = len({t for n, t in union_find(links, sets).items() if sets[n]})
    for heavy in (1 << 22, 500):
        monkeypatch.setattr(near_dedup, "HEAVY", heavy)
        out = near_dedup.near_duplicates(docs(spark, few), k=4).collect()
        assert len({r["component_id"] for r in out if r["n_shingles"]}) == want


def test_near_copies_write_no_file_by_hadoop(spark, near_rows, monkeypatch):
    """Hadoop starts a process for each file it makes in a folder, and leaves a checksum file (.crc) beside it."""
    few = near_rows[-140:]
    want = Counter(map(tuple, near_dedup.near_duplicates(docs(spark, few), k=4).drop("_kid", "_kh").collect()))
    for module, name, value in ((near_dedup, "SMALL", 8), (near_dedup, "CONTRACT", 2), (near_dedup, "HOT_NODES", 50)):
        monkeypatch.setattr(module, name, value)
    top = f"{_common.shared_dir(spark).removeprefix('file://')}/keelson/{spark.sparkContext.applicationId}"
    before = set(os.listdir(top))
    assert Counter(map(tuple, near_dedup.near_duplicates(docs(spark, few), k=4).drop("_kid", "_kh").collect())) == want
    monkeypatch.setattr(components, "LOCAL", 0)
    assert components.components(spark.createDataFrame([(1, 2), (3, 2)], "a long, b long"), "stars").count() == 2
    made = [(d, f) for d in set(os.listdir(top)) - before for _, _, files in os.walk(f"{top}/{d}") for f in files]
    assert {"near-sets", "near-walk-likely", "near-large-first", "edges", "stars"} <= {d.rpartition("-")[0] for d, _ in made}
    assert all(f.startswith("part-") and f.endswith(".parquet") for _, f in made)


def test_rows_come_back_from_tasks_files(spark, monkeypatch, tmp_path):
    """All kinds that an id or a column of an operator has, as Spark's writer keeps them."""
    kinds = "1L AS a, 'x' AS b, 1.50BD AS c, DATE'2020-02-03' AS d, TIMESTAMP'1850-02-03 04:05:06.789012' AS e, TIMESTAMP_NTZ'2020-02-03 04:05:06' AS f, X'00ff' AS g, array(1L, NULL) AS h, array(named_struct('v', true, 'n', 3)) AS i, 2S AS j, 0.5D AS k, map('x', 1) AS l"
    frame = spark.sql(f"SELECT {kinds} UNION ALL SELECT {', '.join(f'NULL AS {c}' for c in 'abcdefghijkl')}").repartition(2)
    own, other = _common.materialize_rows(frame, "rows"), _common.materialize(frame, "rows")
    assert own.schema.simpleString() == other.schema.simpleString() and sorted(map(str, own.collect())) == sorted(map(str, other.collect())) == sorted(map(str, frame.collect()))
    assert _common.materialize_rows(frame.limit(0), "rows").count() == 0
    monkeypatch.setattr(_common, "shared_dir", lambda spark: str(tmp_path))
    assert _common.materialize_rows(frame, "rows").count() == 2


def test_near_recall_in_deep_nodes(spark, monkeypatch):
    """Pairs just above the threshold, among many texts of one template that are below it: nodes branch many times."""
    monkeypatch.setattr(near_dedup, "SMALL", 8)
    rng = random.Random(3)
    template, rows = words(rng, 70, 10**6), []
    for i in range(300):
        one = template + words(rng, 50, 10**6)  # any two share a good third of their shingles
        two = list(one)
        for p in rng.sample(range(70, 120), 3):
            two[p] = f"c{rng.randrange(10**9)}"
        rows += [(2 * i, " ".join(one)), (2 * i + 1, " ".join(two))]
    sets = shingle_sets(rows, 4)
    planted = [i for i in range(300) if 100 * len(sets[2 * i] & sets[2 * i + 1]) >= 80 * len(sets[2 * i] | sets[2 * i + 1])]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(docs(spark, rows), k=4).collect()}
    assert len(planted) > 200 and sum(got[2 * i + 1] == 2 * i for i in planted) >= 0.97 * len(planted)
    assert all(got[i] // 2 == i // 2 for i in got)


def test_near_long_texts_and_ties(spark):
    rng = random.Random(5)
    long = words(rng, 60_000, 10**6)
    rows = [(9, " ".join(long)), (4, " ".join(changed(rng, long, 900))), (4, " ".join(changed(rng, long, 900))), (7, "x " * 50_000), (8, "x " * 40_000)]
    got = Counter((r["doc_id"], r["component_id"]) for r in near_dedup.near_duplicates(docs(spark, rows), k=4).collect())
    assert got == {(9, 4): 1, (4, 4): 2, (7, 7): 1, (8, 7): 1}


def test_near_deduplicated(spark):
    df = docs(spark, [(1, "a b c d e f"), (2, "A b c d e f"), (2, "A b c d e f"), (3, None), (4, None), (None, "x")])
    out = near_dedup.deduplicated(df)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "4", "None"]
    assert near_dedup.deduplicated(df.limit(0)).count() == 0


# -- Fuzzy passages -------------------------------------------------------------------------------------------------------


def quadratic_chain(matches, worth, gap):
    """The best score of any chain, in quadratic time."""
    matches, score = sorted(set(matches)), []
    for j, (x, y) in enumerate(matches):
        best = worth
        for i in range(j):
            px, py = matches[i]
            if px < x and py < y:
                gain = score[i] - gap * ((x - px) + (y - py))
                if gain > 0:
                    best = max(best, worth + gain)
        score.append(best)
    return max(score)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60)), min_size=1, max_size=40))
def test_chains(matches):
    found = passage_chains.chains(matches, 1, 0.05, 4.0)
    assert all(a[0] < b[0] and a[1] < b[1] for c in found for a, b in zip(c, c[1:], strict=False))
    flat = [m for c in found for m in c]
    assert len(flat) == len(set(flat)) == len(set(matches))
    score = 4.0
    for (px, py), (x, y) in zip(found[0], found[0][1:], strict=False):
        score += 4.0 - 0.05 * ((x - px) + (y - py))
    assert abs(score - quadratic_chain(matches, 4.0, 0.05)) < 1e-9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(0, 3), max_size=25))
def test_common_words(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    assert passage_chains.common_words(a, b) == table[-1][-1]


def test_passages(spark):
    rng = random.Random(4)
    passage, other = words(rng, 70), words(rng, 55)
    rows = [(i, " ".join(words(rng, 150))) for i in range(30)]
    rows += [(100 + i, " ".join([*words(rng, rng.randrange(5, 90)), *changed(rng, passage, i % 4), *words(rng, rng.randrange(5, 90))])) for i in range(12)]
    rows += [(200 + i, " ".join([*words(rng, 30), *other, *words(rng, 30)]).upper()) for i in range(3)]
    rows += [(300, "copy " + rows[0][1]), (301, None), (302, ""), (303, "few words"), (100, rows[30][1])]
    out = passage_chains.shared_passages(docs(spark, rows)).collect()
    ids = {i for r in out for i in (r["doc_id"], r["other_doc_id"])}
    assert ids == {0, 300, *range(100, 112), *range(200, 203)}
    text = {i: (t or "").lower().split() for i, t in rows}
    for r in out:
        a, b = text[r["doc_id"]][r["first_word"] : r["end_word"]], text[r["other_doc_id"]][r["other_first_word"] : r["other_end_word"]]
        assert passage_chains.common_words(b, a) == r["common_words"] >= 40 and r["identity"] == r["common_words"] / max(len(a), len(b)) >= 0.8
    assert passage_chains.shared_passages(docs(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(-6, 3), min_size=1, max_size=25))
def test_longest_run(steps):
    sums = [0, *np.cumsum(steps).tolist()]
    first, last = passage_chains.longest_run(sums, 0, len(steps), 1.0)
    assert sums[last] - sums[first] + 1 >= 0
    assert last - first == max(j - i for i in range(len(sums)) for j in range(i, len(sums)) if sums[j] - sums[i] + 1 >= 0)


def brute_places(a, b, n):
    """Places of a in runs of n words that b has too."""
    runs = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return {p for i in range(len(a) - n + 1) if tuple(a[i : i + n]) in runs for p in range(i, i + n)}


def test_two_passages_of_a_pair(spark):
    """At no distance do two passages of one pair of documents cancel each other."""
    rng = random.Random(12)
    rows = []
    for i, (size, gap) in enumerate([(n, g) for n in (60, 200) for g in (0, 10, 25, 50, 80, 100, 150, 250, 400, 700, 900)]):
        one, two = words(rng, size, 10**6), words(rng, size, 10**6)
        rows += [(2 * i + j, " ".join([*words(rng, 20, 10**6), *one, *words(rng, gap, 10**6), *two, *words(rng, 30, 10**6)])) for j in range(2)]
    covered = defaultdict(set)
    for r in passage_chains.shared_passages(docs(spark, rows)).collect():
        assert r["doc_id"] // 2 == r["other_doc_id"] // 2 and r["common_words"] >= 40 and r["identity"] >= 0.8
        covered[r["doc_id"] // 2] |= set(range(r["first_word"], r["end_word"]))
        own = r["doc_id"]
        pair = rows[own][1].split(), rows[r["other_doc_id"]][1].split()
        covered[own // 2, "all"] = brute_places(*pair, 40)
    for i in range(len(rows) // 2):
        assert covered[i, "all"] and covered[i] >= covered[i, "all"]


def test_turns():
    assert passage_chains.turns(np.array([0, 0, 0, 1, 1, 1]), np.array([5, 7, 5, 5, 5, 5])).tolist() == [0, 0, 1, 0, 1, 2]


def test_postings():
    rng = np.random.default_rng(2)
    own = passage_chains.Postings(rng.integers(-9, 9, 500), rng.integers(0, 99, 500), rng.integers(-5, 5, 500)).by_text()
    back = passage_chains.Postings.unpack(own.pack())
    assert all(np.array_equal(getattr(own, x), getattr(back, x)) for x in ("d", "place", "seed"))
    got = sorted(zip(*(v.tolist() for v in passage_chains.hub_matches(own.by_seed())), strict=True))
    want = []
    places = defaultdict(lambda: defaultdict(set))
    for d, place, seed in zip(own.d.tolist(), own.place.tolist(), own.seed.tolist(), strict=True):
        places[seed][d].add(place)
    for texts in places.values():
        hub = min(texts)
        for d in texts:
            if d != hub:
                want += [(hub, d, x, y) for i, x in enumerate(sorted(texts[hub])) for j, y in enumerate(sorted(texts[d])) if i == 0 or j == 0 or i == j]
    assert got == sorted(want)
    near = passage_chains.Postings(np.array([1] * 4 + [2] * 3), np.array([0, 5, 60, 100, 0, 10, 14]), np.arange(7))
    assert passage_chains.clusters(near, 5).tolist() == [False] * 4 + [False] * 3
    near.place[6] = 15
    assert passage_chains.clusters(near, 5).tolist() == [False] * 4 + [True] * 3


def test_lanes_of_a_hot_seed_meet():
    """Texts with a hot seed, dealt over lanes, are linked by the lanes' hubs and these by one."""
    hot = passage_chains.Postings(np.arange(2000), np.zeros(2000, np.int64), np.full(2000, 7))
    cold = passage_chains.Postings(np.arange(3000, 3010), np.zeros(10, np.int64), np.full(10, 7))
    assert (passage_chains._lanes(hot, 70) == 6).all() and (passage_chains._lanes(cold, 70) == -1).all()
    batches = [b for n in range(4) for b in passage_chains._dealt(hot.take(np.arange(500 * n, 500 * n + 500)), np.full(500, 7), 8, np.full(500, n))]
    pairs, left = [], list(passage_chains._dealt(cold, cold.seed, 8))
    for round_ in (batches, left):
        for out in list(passage_chains._hubs(8)(iter(list(round_)))):
            for lane, packed in zip(out.column(0).to_pylist(), out.column(2).to_pylist(), strict=True):
                if lane is None:
                    pairs.append(passage_chains.unpack_matches(packed)[:2])
                else:
                    left += passage_chains._dealt(own := passage_chains.Postings.unpack(packed), own.seed, 8)
    pairs = np.concatenate(pairs, axis=1)
    assert pairs.shape[1] < 2100
    assert len(set(union_find(list(zip(*pairs.tolist(), strict=True)), [*range(2000), *range(3000, 3010)]).values())) == 1


def test_passages_of_one_word(spark):
    """Runs of a single word have one seed only, again and again; a text with a shorter run may be its hub."""
    rng = random.Random(14)
    rows = [(10 * g + i, " ".join([*words(rng, 30, 10**6), *[f"again{g}"] * n, *words(rng, 30, 10**6)])) for g in range(12) for i, n in enumerate((60, 55, 30, 25, 20))]
    got = {tuple(sorted((r["doc_id"], r["other_doc_id"]))) for r in passage_chains.shared_passages(docs(spark, rows)).collect()}
    assert got == {(10 * g, 10 * g + 1) for g in range(12)}


def test_passages_of_copies_and_long_texts(spark):
    rng = random.Random(6)
    one, long = words(rng, 60, 10**6), words(rng, 60_000, 10**6)
    rows = [(1, " ".join(long)), (2, " ".join([*words(rng, 30, 10**6), *long[40_000:40_050], *words(rng, 30, 10**6)])), (5, " ".join(one)), (3, " ".join(one)), (3, " ".join(one)), (None, " ".join(one)), (7, "short one"), (8, "short one")]
    rows += [(20 + i, " ".join(["common line of a dozen words that stands in very many of them all"] + words(rng, 50, 10**6))) for i in range(300)]
    out = {(r["doc_id"], r["other_doc_id"]): r for r in passage_chains.shared_passages(docs(spark, rows)).collect()}
    copies = {(5, 3), (None, 3)}
    assert copies <= set(out) and len(out) == 3 and set(out) - copies <= {(1, 2), (2, 1)}
    assert all(out[p]["common_words"] == 60 and out[p]["identity"] == 1.0 for p in copies)


def test_passages_that_a_hub_holds_in_part(spark):
    """Texts that quote a part of a passage, too short to be one, don't hide the passage from its other documents."""
    rng = random.Random(21)
    rows, want = [], set()
    for g in range(24):
        one = words(rng, 60, 10**6)
        at = rng.randrange(0, 22)
        ids = list(range(10 * g, 10 * g + 5))
        for i in ids[:2]:
            rows.append((i, " ".join([*words(rng, 25, 10**6), *one, *words(rng, 25, 10**6)])))
        for i in ids[2:]:  # each may be the least of all by hash
            rows.append((i, " ".join([*words(rng, 25, 10**6), *one[at : at + 39], *words(rng, 25, 10**6)])))
        want.add((ids[0], ids[1]))
    got = {tuple(sorted((r["doc_id"], r["other_doc_id"]))) for r in passage_chains.shared_passages(docs(spark, rows)).collect()}
    assert got == want


@pytest.mark.parametrize("tile", [8, 1024])
def test_passages_beyond_large_groups(spark, monkeypatch, tile):
    """Pairs whose common seeds are all in groups larger than PAIRS, and that share nothing more with the group's hub."""
    monkeypatch.setattr(passage_chains, "PAIRS", 4)
    monkeypatch.setattr(passage_chains, "TILE", tile, raising=False)
    rng = random.Random(8)
    line, other, seen = words(rng, 22), words(rng, 22), []

    def edited(base):  # no five words in a row stay, so that there are no common seeds
        return [f"x{rng.randrange(1 << 40)}" if i % 5 == 4 else w for i, w in enumerate(base)]

    rows = [words(rng, 30) + line + words(rng, 30) for _ in range(15)] + [words(rng, 9) + line + words(rng, 50) + other + words(rng, 9) for _ in range(15)]
    rows += [words(rng, 20) + ["the"] * rng.randrange(20, 35) + words(rng, 30) for _ in range(15)]
    before, after, between, around = words(rng, 14), words(rng, 14), words(rng, 8), words(rng, 16)
    for planted in (
        [edited(before) + line + edited(after) for _ in range(2)],  # words on both sides
        [line + edited(between)[:size] + other for size in (8, 5)],  # two lines, not as far from each other
        [edited(around) + ["the"] * size for size in (33, 36)],  # runs of one word, of different sizes
    ):
        seen.append((len(rows), len(rows) + 1))
        rows += [words(rng, 25) + p + words(rng, 25) for p in planted]
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    found = passage_chains.shared_passages(docs(spark, rows)).collect()
    got = {tuple(sorted((r["doc_id"], r["other_doc_id"]))) for r in found}
    assert set(seen) <= got, set(seen) - got
    monkeypatch.setattr(passage_chains, "PAIRS", 10**6)
    assert got == {tuple(sorted((r["doc_id"], r["other_doc_id"]))) for r in passage_chains.shared_passages(docs(spark, rows)).collect()}


@pytest.mark.parametrize(("size", "edits", "least"), [(40, 0, 1.0), (60, 3, 0.98), (60, 6, 0.98), (60, 9, 0.95), (60, 12, 0.85), (100, 20, 0.95)])
def test_recall_of_passages(spark, size, edits, least):
    """Of pairs with a passage at identity 1 to 0.8, by independent edits, nearly all are found."""
    rng = random.Random(size + edits)
    rows = []
    for i in range(150):
        one = words(rng, size, 10**9)
        two = list(one)
        for p in rng.sample(range(size), edits):
            two[p] = f"c{rng.randrange(10**9)}"
        rows += [(2 * i + j, " ".join([*words(rng, 60, 10**9), *text, *words(rng, 60, 10**9)])) for j, text in enumerate((one, two))]
    out = passage_chains.shared_passages(docs(spark, rows)).collect()
    assert all(r["doc_id"] // 2 == r["other_doc_id"] // 2 for r in out)
    assert len({r["doc_id"] // 2 for r in out}) >= least * 150


# -- Suffixes -------------------------------------------------------------------------------------------------------------


def prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("external", [False, True])
@settings(max_examples=120, deadline=None)
@given(text=st.one_of(st.binary(min_size=1, max_size=80), st.text("ab", min_size=1, max_size=120).map(str.encode), st.text("abc", min_size=1, max_size=40).map(lambda s: (s * 3).encode())))
def test_suffix_order(external, text):
    """external: queues on disk, small blocks, recursion down to three names."""
    block, suffix_sort.BLOCK = suffix_sort.BLOCK, 7 if external else 1 << 18
    try:
        blocks = list(suffix_sort.descending(np.frombuffer(text, np.uint8), 1000, **(dict(in_memory=4, base_case=3) if external else {})))
    finally:
        suffix_sort.BLOCK = block
    order = sorted(range(len(text)), key=lambda i: text[i:], reverse=True)
    assert np.concatenate([b[0] for b in blocks]).tolist() == order
    assert np.concatenate([b[1] for b in blocks]).tolist() == [0] + [prefix(text[a:], text[b:]) for a, b in zip(order, order[1:], strict=False)]


def test_sort_beyond_memory():
    """Of a text larger than what a sort may hold, the same strings are found with the arrays on disk. What stays in memory is
    a queue object for each distinct name of a recursion."""
    import tracemalloc

    rng = np.random.default_rng(8)
    text = rng.integers(97, 101, 1 << 18).astype(np.uint8)
    for _ in range(300):
        a, b = rng.integers(0, len(text) - 200, 2)
        text[a : a + 150] = text[b : b + 150]
    block, suffix_sort.BLOCK = suffix_sort.BLOCK, 1 << 13
    got, peak = [], []
    try:
        for sizes in ({"in_memory": 1 << 26}, {"in_memory": 1 << 13, "base_case": 1 << 13}):
            tracemalloc.start()
            got.append(suffix_sort.repeated(text, 120, **sizes))
            peak.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()
    finally:
        suffix_sort.BLOCK = block
    assert np.array_equal(*got) and 0 < got[0].sum() < len(text)
    assert peak[1] < 0.7 * peak[0]


def brute_removed(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                covered[i : i + length] = True
        runs = int((np.diff(np.concatenate([[0], covered.astype(int)])) == 1).sum())
        out.append((len(t), int(covered.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~covered].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "seed"), [(40, 8), (400, 32)])
def test_removed(spark, monkeypatch, length, seed):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)  # so that groups are split
    rng = random.Random(length)
    passage = " ".join(words(rng, length // 3))
    texts = [" ".join(words(rng, rng.randrange(1, length // 2))) for _ in range(25)]
    texts += [f"{' '.join(words(rng, 9))} {passage} {' '.join(words(rng, rng.randrange(1, 30)))}" for _ in range(14)]
    base = words(rng, length // 2)
    texts += [" ".join(changed(rng, base, k % 3)) for k in range(12)]
    texts += [passage + passage, "é" * length, "a" * (3 * length), "ab" * length, None, "", "short", texts[0], texts[0], "漢字" * 5 + passage]
    rows = [*enumerate(texts), (0, texts[0]), (None, passage)]
    out = suffix_dedup.remove_repeated(docs(spark, rows), length, seed).collect()
    got = Counter((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out)
    assert got == Counter((i, *e) for (i, _), e in zip(rows, brute_removed([(t or "").encode() for _, t in rows], length), strict=True))


def test_removed_long(spark, monkeypatch):
    """Anchors may stand more than 512 places into a string."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    rng = random.Random(31)
    passage = " ".join(words(rng, 500))
    texts = [f"{' '.join(words(rng, 9))} {passage[c : c + 1100]} {' '.join(words(rng, 30))}" for c in range(0, 900, 45)]
    out = suffix_dedup.remove_repeated(docs(spark, [*enumerate(texts)]), 900, 16).collect()
    got = {r["doc_id"]: (r["n_bytes"] - len(r["kept"]), hashlib.sha256(r["kept"]).hexdigest()) for r in out}
    assert got == {i: (e[1], e[3]) for i, e in enumerate(brute_removed([t.encode() for t in texts], 900))}


def test_removed_empty(spark):
    assert suffix_dedup.digest(docs(spark, [])).count() == 0
    assert [tuple(r)[1:4] for r in suffix_dedup.digest(docs(spark, [(1, None)])).collect()] == [(0, 0, 0)]


def test_parts_of_long_texts_give_all_strings():
    """Segments of overlapping parts hold each string of the text."""
    rng = random.Random(9)
    text = np.frombuffer(" ".join(words(rng, 200)).encode(), np.uint8)
    for part in (100, 300, len(text)):
        seen = set()
        for lo in range(0, len(text) - 39, part - 39):
            data = text[lo : lo + part]
            _, _, _, start, size, place = suffix_dedup._segments(data, np.array([0, len(data)]), 40, 8)
            assert ((place >= 0) & (size >= 40)).all()
            seen |= {lo + s + i for s, n in zip(start, size, strict=True) for i in range(n - 39)}
        assert seen == set(range(len(text) - 39))


def test_tasks_write_their_own_files(spark, monkeypatch, tmp_path):
    """Hadoop starts a process for each file it makes in a folder, and leaves a checksum file (.crc) beside it."""
    frame = spark.createDataFrame([(i, bytes([i])) for i in range(40)], "n bigint, packed binary").repartition(3)

    def same(batches):
        yield from batches

    out = _common.materialize_arrow(frame, same, "n bigint, packed binary", "own")
    assert sorted(map(tuple, out.collect())) == [(i, bytes([i])) for i in range(40)]
    made = [f for _, _, files in os.walk(out.keelson_path.removeprefix("file://")) for f in files]
    assert len(made) == 3 and all(f.startswith("part-") and f.endswith(".parquet") for f in made)
    _common.discard(out)
    assert not os.path.exists(out.keelson_path.removeprefix("file://"))
    assert _common.materialize_arrow(frame.where("n < 0"), same, "n bigint, packed binary", "own").count() == 0
    # A folder that isn't a path is left to Spark's writer.
    monkeypatch.setattr(_common, "shared_dir", lambda spark: f"file:{tmp_path}")
    assert _common.materialize_arrow(frame, same, "n bigint, packed binary", "own").count() == 40
    monkeypatch.setattr(_common, "shared_dir", lambda spark: str(tmp_path))
    assert _common.materialize_arrow(frame, same, "n bigint, packed binary", "own").count() == 40
    assert any(f.endswith(".crc") for _, _, files in os.walk(tmp_path) for f in files)


def test_first_attempt_at_a_file_stays(monkeypatch, tmp_path):
    class Context:
        def __init__(self, attempt):
            self.attempt = attempt

        def partitionId(self):  # noqa: N802
            return 0

        def taskAttemptId(self):  # noqa: N802
            return self.attempt

    def broken(batches):
        yield from batches
        raise ValueError

    for attempt, run in enumerate((broken, iter, iter)):
        monkeypatch.setattr(_common.TaskContext, "get", lambda attempt=attempt: Context(attempt))
        with contextlib.suppress(ValueError):
            list(_common._to_file(run, str(tmp_path))(iter([pa.record_batch({"n": [attempt]})])))
    assert os.listdir(tmp_path) == ["part-00000.parquet"] and pq.read_table(tmp_path / "part-00000.parquet")["n"].to_pylist() == [1]


def test_chains_write_no_file_by_hadoop(spark, monkeypatch):
    """Only steps that don't end in Python are left to Spark's writer; chains of a text in several rows give the same passages."""
    rng, labels = random.Random(5), []
    monkeypatch.setattr(passage_chains, "materialize", lambda df, label, put=passage_chains.materialize: labels.append(label) or put(df, label))
    common = words(rng, 60)
    rows = [(i, " ".join(words(rng, 30) + common + words(rng, 30))) for i in range(12)]
    get = lambda: sorted(map(tuple, passage_chains.shared_passages(docs(spark, rows)).collect()))
    one = get()
    assert not {"chain-lists", "chain-postings", "chains", "chain-passages", "chain-open", "chain-found"} & set(labels)
    monkeypatch.setattr(passage_chains, "SIDES", 2)
    assert len(one) >= 11 and get() == one


def slow_can_hold(equal, k, least_words, least_identity):
    """By all spans around the middle, each run of k equal words joined with those up to COMPACT words on."""
    out = []
    for row in equal.tolist():
        runs = [i for i in range(len(row) - k + 1) if all(row[i : i + k])]
        same = list(row)
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            if b - a <= passage_chains.COMPACT:
                same[a : b + 1] = [True] * (b - a + 1)
        middle = (len(row) - k) // 2
        spans = [(i, j) for i in range(middle + 1) for j in range(middle + k, len(row) + 1)]
        out.append(any(sum(same[i:middle]) + k + sum(same[middle + k : j]) >= max(least_words, least_identity * (j - i) - 1e-9) for i, j in spans))
    return out


def test_can_hold():
    rng = np.random.default_rng(4)
    equal = rng.random((120, 65)) < rng.choice([0.3, 0.6, 0.75, 0.9], (120, 1))
    equal[:, 30:35] = True
    got = passage_chains.can_hold(equal, 5, 20, 0.8).tolist()
    assert got == slow_can_hold(equal, 5, 20, 0.8) and 10 < sum(got) < 110


def test_matches_of_a_pair_by_places():
    rng = np.random.default_rng(3)
    for _ in range(50):
        one, two = (passage_chains.Postings(np.full(n, n), np.arange(n), rng.integers(0, 12, n)) for n in (30, 40))
        want = set()
        for seed in set(one.seed.tolist()) & set(two.seed.tolist()):
            xs, ys = (p.place[p.seed == seed].tolist() for p in (one, two))
            want |= {(xs[0], y) for y in ys} | {(x, ys[0]) for x in xs} | set(zip(xs, ys, strict=False))
        assert {(x, y) for x, y in passage_chains.pair_matches(one, two)} == want
