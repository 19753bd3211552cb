"""Exact dedup, URL filter and mixing."""

import hashlib
import uuid
from collections import defaultdict
from math import isclose
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keelson.llm import exact_dedup, mixing, near_dedup, url_filter
from keelson.llm._common import attach, discard, materialize, shared_dir, with_key
from keelson.llm.url_filter import Rule

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string, row int"


def docs(spark, *rows):
    """(id, text, source) with columns whose names clash with the results'."""
    return spark.createDataFrame([(i, t, None, s, None, 7, "x", 1) for i, t, s in rows], DOCS)


def by_id(df):
    return {r[0]: r for r in df.collect()}


# -- Exact dedup ----------------------------------------------------------------------------------------------------------


def test_dedup_contract(spark):
    texts = {1: "Hello", 2: "hello", 3: None, 4: "", 5: "HÉ", 6: "hé", 7: "hÉ", 8: "x" * 200_000}
    out = by_id(exact_dedup.dedup(docs(spark, *((i, t, "s") for i, t in texts.items()))))
    normal = {i: (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for i, t in texts.items()}
    groups = defaultdict(list)
    for i, t in normal.items():
        groups[t].append(i)
    for i, t in normal.items():
        r, g = out[i], groups[t]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest())


def test_dedup_null_and_repeated_ids(spark):
    out = exact_dedup.dedup(docs(spark, (None, "a", "s"), (3, "a", "s"), (3, "a", "s"), (None, "b", "s"))).collect()
    assert sorted(((str(r["doc_id"]), r["keep_id"], r["kept"]) for r in out), key=str) == [("3", 3, False), ("3", 3, True), ("None", 3, False), ("None", None, True)]
    assert exact_dedup.dedup(docs(spark)).count() == 0


def test_deduplicated_keeps_columns(spark):
    df = docs(spark, (1, "a", "s"), (2, "A", "t"), (2, "A", "t"), (None, "b", None), (5, None, "s"))
    out = exact_dedup.deduplicated(df)
    assert out.columns == df.columns and sorted((str(r["doc_id"]), r["source"]) for r in out.collect()) == [("2", "t"), ("5", "s"), ("None", None)]
    assert exact_dedup.deduplicated(df.limit(0)).count() == 0


def test_persistent_index(spark):
    name = f"index_{uuid.uuid4().hex}"
    first = exact_dedup.DigestIndex(spark, name, buckets=3)
    assert {r["doc_id"] for r in exact_dedup.deduplicated(docs(spark, (1, "a", "s"), (2, "b", "s")), first).collect()} == {1, 2}
    again = exact_dedup.DigestIndex(spark, name)
    assert again.buckets == 3
    out = by_id(exact_dedup.dedup(docs(spark, (3, "B", "s"), (4, "c", "s"), (5, "c", "s")), again))
    assert [(i, out[i]["keep_id"], out[i]["kept"]) for i in (3, 4, 5)] == [(3, 2, False), (4, 5, False), (5, 5, True)]
    assert again.entries().count() == 3
    plan = spark.range(1).select(F.col("id").cast("string").alias("text_sha256")).join(again.entries().hint("merge"), "text_sha256", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1 and "SortMergeJoin" in plan  # the index side isn't shuffled
    again.drop()


def test_a_repeated_batch_gives_the_same(spark):
    """A call that failed after its append and runs again finds its own entries, and keeps the same rows."""
    index = exact_dedup.DigestIndex(spark, f"index_{uuid.uuid4().hex}", buckets=2)
    exact_dedup.deduplicated(docs(spark, (1, "old", "s")), index, batch="one").collect()
    rows = docs(spark, (2, "old", "s"), (3, "new", "s"), (4, "NEW", "s"), (5, "other", "s"))
    kept = [sorted(r["doc_id"] for r in exact_dedup.deduplicated(rows.repartition(n), index, batch="two").collect()) for n in (1, 3)]
    assert kept == [[4, 5], [4, 5]] and index.entries().count() == 3
    index.compact()
    assert index.entries().count() == 3 and sorted(r["doc_id"] for r in exact_dedup.deduplicated(rows, index, batch="two").collect()) == [4, 5]
    assert exact_dedup.deduplicated(rows, index, batch="three").count() == 0
    index.drop()


def test_names_of_the_input_are_kept(spark):
    """Columns named like those that operators use within."""
    names = ["doc_id", "text", "lang", "source", "_kid", "_kh", "_values", "_rank", "_kept", "_stays", "_copies", "doc", "values", "kept", "stays", "copies", "n"]
    df = spark.createDataFrame([(i, f"some words {i // 2}", "en", "s", *[f"{c}{i}" for c in names[4:]]) for i in range(6)], names)
    for f in (exact_dedup.deduplicated, near_dedup.deduplicated, mixing.mixed):
        out = f(df)
        assert out.columns == names and out.count() and all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in names[4:])


def test_repeated_rows_share_their_values(spark):
    """Of rows with one id and text, as many get each value as there are decisions with it; other columns may differ."""
    df = spark.createDataFrame([(1, "a", k % 2) for k in range(7)] + [(2, "b", 0)] * 3 + [(3, "c", 0)], "doc_id long, text string, x int")
    keyed = with_key(df.select("doc_id", "text")).select("_kid", "_kh")
    own = lambda i: keyed.where(f"_kid = '{i}'")
    decisions = own(1).limit(4).withColumn("v", F.lit(2)).union(own(1).limit(3).withColumn("v", F.lit(0))).union(own(2).withColumn("v", F.lit(5)))
    out = attach(df, decisions, "v").select("doc.*", "v").collect()
    assert sorted((r["doc_id"], r["v"]) for r in out) == [(1, 0)] * 3 + [(1, 2)] * 4 + [(2, 5)] * 3
    assert sorted(r["x"] for r in out if r["doc_id"] == 1) == [0] * 4 + [1] * 3


def test_shared_folder(spark):
    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
    table = materialize(spark.range(3), "test")
    assert table.count() == 3 and table.keelson_path.startswith(shared_dir(spark))
    discard(table)
    assert not Path(table.keelson_path.removeprefix("file:")).exists()


def test_dedup_stays_native(spark):
    plan = exact_dedup.dedup(docs(spark, (1, "a", "s")))._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))


# -- URL filter -----------------------------------------------------------------------------------------------------------


def pages(spark, *rows):
    return spark.createDataFrame([(i, u, h, "clash", 1.0) for i, u, h in rows], "page_id long, url string, html string, host string, trust double")


def brute(url):
    """host, path, rule by the contract."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, tail = rest[:cut].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), rest[cut:]
    path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(v, h + p) for v, h, p in (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")) if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: len(f[1]), default=(None, None))
    return host, path, best[1], best[0]


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG/en/12?x=/es/", "https://example.org/es/#f", "http://xexample.org/es/1", "http://org/", "http://org", "http://a.com/fr/x", "http://a.com/de/y", "http://com?/fr/", "http://É.com/fr/", "x://a://b/c", "http://b.net/de/1", "http://a.org:80/q", "http://u@c.com/de/\nz"]


def test_rules(spark):
    out = by_id(url_filter.judge(pages(spark, *((i, u, None) for i, u in enumerate(URLS)))))
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u)
        assert (out[i]["host"], out[i]["path"], out[i]["rule"]) == (host, path, rule)
        assert out[i]["verdict"] == verdict if verdict else out[i]["verdict"] in ("allow", "block")
    assert url_filter.judge(pages(spark)).count() == 0


def test_propagation_against_power_series(spark):
    links = {"a": ["b", "b", "c"], "b": ["c"], "c": ["a", "d"], "e": ["d"]}
    edges = spark.createDataFrame([(s, t, ts.count(t)) for s, ts in links.items() for t in dict.fromkeys(ts)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("a", 1.0, 0.0), ("d", 0.0, 1.0)], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in url_filter.propagate(edges, seeds, rounds=5, cut=2).collect()}

    def series(ways, seed):
        total, mass = defaultdict(float), {seed: 0.15}
        for _ in range(6):
            for h, v in mass.items():
                total[h] += v
            step = defaultdict(float)
            for h, v in mass.items():
                for t in ways.get(h, []):
                    step[t] += 0.85 * v / len(ways[h])
            mass = step
        return total

    back = defaultdict(list)
    for s, ts in links.items():
        for t in ts:
            back[t].append(s)
    good, bad = series(links, "a"), series(back, "d")
    for h in "abcde":
        assert isclose(got.get(h, (0, 0))[0], good[h], abs_tol=1e-9) and isclose(got.get(h, (0, 0))[1], bad[h], abs_tol=1e-9)


def test_distrust_reaches_linking_hosts(spark):
    link = '<a class=x HREF="http://Bad.com/de/1?q">x</a> <a href=/local>l</a>'
    out = by_id(url_filter.judge(pages(spark, (1, "http://bad.com/de/1", None), (2, "http://farm.net/a", link), (3, "http://clean.net/a", '<a href="//good.org/x">'), (4, "http://good.org/x", ""))))
    assert [out[i]["verdict"] for i in (1, 2, 3, 4)] == ["block", "block", "allow", "allow"]
    assert out[2]["distrust"] > 0 and out[3]["distrust"] == 0


def test_small_scores_are_kept(spark):
    """Distrust of a large graph, far below a seed's share, still counts."""
    edges = spark.createDataFrame([("farm", "bad", 1), ("far", "farm", 1)], "src string, dst string, n long")
    seeds = spark.createDataFrame([("bad", 0.0, 1e-13)], "host string, trust double, distrust double")
    got = {r["host"]: r["distrust"] for r in url_filter.propagate(edges, seeds).collect()}
    assert isclose(got["farm"], 0.15 * 0.85 * 1e-13, rel_tol=1e-9) and isclose(got["far"], 0.15 * 0.85**2 * 1e-13, rel_tol=1e-9)


def test_equal_rules_block(spark):
    out = url_filter.judge(pages(spark, (1, "http://a.b/c", None)), [Rule("allow", "a.b", "/c"), Rule("block", "a.b", "/c")]).first()
    assert out["verdict"] == "block"


# -- Mixing ---------------------------------------------------------------------------------------------------------------


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        share = {s: left * weight[s] / rest for s in names if s not in full} if rest else {}
        over = {s for s, x in share.items() if x > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in full else share[s] for s in names}
        full |= over


@pytest.fixture
def corpus(spark):
    words = lambda n: " ".join(["w"] * n)
    sizes = {"a": 40, "b": 3, "Z": 300, "é": 25, None: 60, "c": 1, "d": 500}
    rows, n = [], 0
    for source, count in sizes.items():
        for k in range(count):
            rows.append((n, words(20 + (k * 7) % 50), source))
            n += 1
    return docs(spark, *rows, (n, None, "a"), (n + 1, " \n", "d"), (n + 2, "", "empty"))


def test_mix(corpus):
    out = mixing.mix(corpus).cache()
    rows = out.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
    expected = brute_targets(dict(sizes))
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and isclose(r["target"], expected[r["source"]], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r["taken"] <= 3 * r["size"] and r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    for s, t in expected.items():
        assert abs(taken[s] - t) <= max(0.01 * t, 20)
    again = mixing.mix(corpus.repartition(7))
    assert sorted((r["doc_id"], r["taken"]) for r in rows) == sorted((r["doc_id"], r["taken"]) for r in again.collect())


def test_mix_edges(spark):
    assert mixing.mix(docs(spark)).count() == 0
    assert [r["taken"] for r in mixing.mix(docs(spark, (1, None, "a"), (2, "", None))).collect()] == [0, 0]
    one = mixing.mix(docs(spark, (1, "a b c", "s"), (1, "a b c", "s"), (None, "d", "s"))).collect()
    assert sum(r["taken"] for r in one) == 7 and all(r["taken"] == r["size"] for r in one)


def test_a_tiny_source_changes_no_block(spark, corpus):
    """One more source, of one word, leaves the number of slots as it is, and every source is filled to the word."""
    more = corpus.unionByName(docs(spark, (10**6, "w", "~tiny"), (10**6 + 1, "w " * 30_000, "~~long")))
    out = mixing.mix(more).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in out:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in brute_targets(dict(sizes)).items()) and sum(taken.values()) <= sum(sizes.values()) + len(sizes)
    for block in (1, 7, 500):
        again = mixing.mix(more, block=block).groupBy("source").agg(F.sum("taken").alias("n")).collect()
        assert {r["source"]: r["n"] for r in again} == taken


def test_mixed_documents(corpus):
    out = mixing.mixed(corpus)
    assert out.columns == corpus.columns
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(corpus).collect()}
    got = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {i: n for i, n in copies.items() if n}


def test_schedule_prefixes_are_close(spark):
    sources = spark.createDataFrame([(0, 10**6, 1.0), (1, 10**6, 2.0), (2, 10**6, 5.0)], "sid int, source_size long, target double")
    for n in (80, 800, 8000):
        got = {r["sid"]: r["n"] for r in mixing.schedule(sources, n, 1).groupBy("sid").agg(F.sum("times").alias("n")).collect()}
        assert all(abs(got[s] - n * w / 8) <= 4 for s, w in ((0, 1), (1, 2), (2, 5)))
