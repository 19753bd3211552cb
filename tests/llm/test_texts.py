"""Words, quality rules, token counts, SentencePiece and lattice scores."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from keelson.llm import _text, lm_score, quality, sentencepiece_codec, token_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n\n", "a", "A b\tc\x0bd", "x\nx\n\nx \nx", "é ü\x00 \x00", "a b c a b c a b c d", "漢字 😀 #$ <|endoftext|> it's 123,456", "A\r\nA\r\n", "z" * 5000, "w " * 3000, "\u00a0a\u2003b"]
TEXTS = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab#\n \tÉé漢😀\x00"), max_size=60)), max_size=8)
DOCS = "doc_id long, text string, lang string, source string, n_words int, grp string, score double, pieces string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "g", 0.5, "p") for i, t, lang, s in rows], DOCS)


def lower(text):
    return (text or "").encode().lower()


# -- Words and lines ------------------------------------------------------------------------------------------------------


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(lines)]


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_statistics(texts):
    texts = texts + ODD
    got = np.concatenate([quality.base_statistics(b) for b in _text.blocks(pa.array(texts, pa.string()))])
    assert got[:, :6].tolist() == [brute_statistics(t) for t in texts]


def test_blocks_cover_all(monkeypatch):
    monkeypatch.setattr(_text, "BLOCK", 64)
    texts = ODD + [None, "end"]
    parts = list(_text.blocks(pa.array(texts)))
    assert len(parts) > 3 and b"".join(p.data.tobytes() for p in parts) == b"".join((t or "").encode() for t in texts)
    sliced = pa.array(texts).slice(2, 5)
    assert sum(p.n for p in _text.blocks(sliced)) == 5


# -- Quality --------------------------------------------------------------------------------------------------------------


def test_chi2():
    assert abs(quality.chi2_cdf(12.592, 6) - 0.95) < 1e-4 and abs(quality.chi2_quantile(0.975, 6) - 14.449) < 1e-3 and abs(quality.consistency(1 - 1e-12) - 1) < 1e-6


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for i in range(900):
        words = rng.choice(vocabulary, rng.integers(60, 150))
        text = " ".join(words).capitalize() + "."
        if i % 30 == 0:
            text = " ".join(w + "&&&" for w in words)
        rows.append((i, text, "en" if i % 2 else None, f"s{i % 3}"))
    return rows + [(900, None, None, None), (901, "short", "xx", "rare"), (902, " ".join(["one two three"] * 30), "en", "s1"), (903, text, "xx", "rare")]


def test_quality(spark, corpus):
    out = {r["doc_id"]: r for r in quality.judge(docs(spark, corpus)).collect()}
    assert len(out) == len(corpus)
    for i, text, *_ in corpus:
        r, b = out[i], brute_statistics(text)
        assert [r[c] for c in quality.STATS[:6]] == b
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
        if i < 900:
            assert r["kept"] == (i % 30 != 0)
    kept = quality.keep_documents(docs(spark, corpus))
    assert kept.columns == DOCS.replace(",", "").split()[::2] and {r["doc_id"] for r in kept.collect()} == {i for i, r in out.items() if r["kept"]}


def test_fit_is_the_covariance_of_the_near_rows(spark, corpus):
    """Against numpy: the last step's fit, from the same distances, on one group."""
    stats = quality.statistics(docs(spark, corpus)).cache()
    fits = {r["grp"]: (np.array(r["mu"]), np.array(r["inv"]).reshape(quality.D, quality.D)) for r in quality.fit(stats).collect()}
    assert "" in fits
    x = np.array([list(r) for r in stats.where(~quality.base_failed()).select(*quality.features()).collect()], float)
    mu, inv = fits[""]
    near = x[np.einsum("ij,jk,ik->i", x - mu, inv, x - mu) <= quality.chi2_quantile(0.975, quality.D)]
    assert len(near) > 0.7 * len(x) and np.abs(near.mean(axis=0) - mu).max() < 0.02
    assert all(np.linalg.eigvalsh(inv).min() > 0 for _, inv in fits.values())


def brute_fit(x):
    """The least determinant of three starts, in plain numpy: location and inverse scatter."""
    n, d = x.shape
    least = np.array(quality.LEAST_SD)

    def inverse(scatter):
        values, vectors = np.linalg.eigh(scatter / least[:, None] / least[None])
        values = np.maximum(values, 1)
        return vectors @ np.diag(1 / values) @ vectors.T / least[:, None] / least[None], np.log(values).sum()

    def distances(mu, inv):
        return np.einsum("ij,jk,ik->i", x - mu, inv, x - mu)

    middle = lambda a: np.sort(a, axis=0)[math.ceil(n / 2) - 1]
    mid = middle(x)
    scale = np.maximum(1.4826 * middle(np.abs(x - mid)), least)
    z = (x - mid) / scale
    with np.errstate(all="ignore"):
        by_tanh = np.nan_to_num(np.corrcoef(np.tanh(z).T))
        signs = z / np.sqrt(np.maximum((z * z).sum(axis=1), 1e-18))[:, None]
        by_sign = signs.T @ signs
        by_sign = np.nan_to_num(by_sign / np.sqrt(np.outer(np.diag(by_sign), np.diag(by_sign))))
    tried = []
    for r in (np.eye(d), by_tanh, by_sign):
        np.fill_diagonal(r, 1)
        mu, (inv, _) = mid, inverse(r * np.outer(scale, scale))
        for _ in range(quality.STEPS):
            bins = np.floor(np.log2(np.maximum(distances(mu, inv), 1e-9)) * quality.BINS_PER_OCTAVE)
            near = x[bins <= np.sort(bins)[math.ceil(quality.COVERAGE * n) - 1]]
            mu = near.mean(axis=0)
            inv, log_det = inverse((near.T @ near / len(near) - np.outer(mu, mu)) * quality.consistency(quality.COVERAGE))
        tried.append((log_det, mu, inv))
    _, mu, inv = min(tried, key=lambda t: t[0])
    near = x[distances(mu, inv) <= quality.chi2_quantile(0.975, d)]
    mu = near.mean(axis=0)
    return mu, inverse((near.T @ near / len(near) - np.outer(mu, mu)) * quality.consistency(0.975))[0]


def test_verdicts_by_brute_force(spark, corpus, monkeypatch):
    monkeypatch.setattr(quality, "LEAST_ROWS", 120)
    stats = quality.statistics(docs(spark, corpus)).cache()
    found = stats.select("id", "grp", quality.base_failed().alias("failed"), *[f.alias(f"x{i}") for i, f in enumerate(quality.features())]).toPandas()
    x = found[[f"x{i}" for i in range(quality.D)]].to_numpy()
    passed = ~found["failed"].to_numpy()
    fits = {g: brute_fit(x[passed & (found["grp"] == g).to_numpy()]) for g, n in found[passed]["grp"].value_counts().items() if n >= 120}
    assert len(fits) > 3
    pooled = brute_fit(x[passed])
    cutoff = quality.chi2_quantile(1 - quality.REJECT, quality.D)
    for broadcast in (1 << 20, 0):  # fits broadcast, or joined with salts
        monkeypatch.setattr(quality, "BROADCAST_BYTES", broadcast)
        out = {r["doc_id"]: r for r in quality.judge(docs(spark, corpus)).collect()}
        for own, i, g, failed in zip(x, found["id"], found["grp"], found["failed"], strict=True):
            mu, inv = fits.get(g, pooled)
            d2 = (own - mu) @ inv @ (own - mu)
            assert math.isclose(out[i]["distance"], d2, rel_tol=1e-6, abs_tol=1e-6)
            assert out[i]["kept"] == (not failed and d2 <= cutoff)


def test_quality_empty(spark):
    assert quality.judge(docs(spark, [])).count() == 0 and quality.keep_documents(docs(spark, [])).count() == 0
    few = quality.judge(docs(spark, [(1, "word " * 60, "a", "b"), (1, " ".join(f"w{i}" for i in range(60)), None, None)])).collect()
    assert sorted(r["kept"] for r in few) == [False, True]


# -- Token counts ---------------------------------------------------------------------------------------------------------


def test_token_counts(spark, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ODD + ["x<|endoftext|><|endoftext|> y", "  'll  'S don't\n\n x  ", "a" * 700, "1 2 3 " * 300]
    rows = docs(spark, [(i, t, None, None) for i, t in enumerate([*texts, None])])
    out = {r["doc_id"]: r for r in token_count.count_tokens(rows).collect()}
    for i, t in enumerate([*texts, None]):
        n = len(library.encode(t or "", add_special_tokens=False))
        assert (out[i]["n_tokens"], out[i]["n_bytes"], out[i]["over_limit"]) == (n, len((t or "").encode()), n > 512)
    # Many slabs, each with a few pre-tokens only.
    monkeypatch.setattr(token_count, "SLAB_DISTINCT", 3)
    assert {r["doc_id"]: r for r in token_count.count_tokens(rows).collect()} == out
    parts = token_count.Dictionary(5, 1, 1)
    for t in texts:
        parts.add(token_count.PieceCounter(public_tokenizers.path("byte_bpe_50k.json")).pretokens(t)[0])
    dictionary, coded = parts.parts()
    words = [w for _, part in dictionary for w in token_count.words_of(part)]
    assert sorted(words) == sorted(parts.codes) and [len(c) // 4 for c in coded] == [len(d) for d in parts.docs]
    for d, c in zip(parts.docs, coded, strict=True):
        assert sorted(words[k] for k in np.cumsum(token_count.values(c))) == sorted(list(parts.codes)[k] for k in d)
    assert token_count.count_tokens(docs(spark, [])).count() == 0


# -- SentencePiece --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=40))
def test_round_trip(text):
    own = sentencepiece_codec.codec(public_tokenizers.path("piece_bpe_32k.model"))
    assert own.decode(own.encode(text)) == text


def test_equals_library(codec):
    """The library's own Viterbi, on the same pieces and scores."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as model

    proto = model.ModelProto()
    proto.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = model.TrainerSpec.UNIGRAM
    for i, score in codec.pieces.score.items():
        proto.pieces[i].score = score
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for text in ["Hello world", "the quick  brown fox", "Éoireeau de la", "漢字 and 😀 mixed", "of%%% to%%%", "a\nb\tc", "unbelievable internationalisation", "ſ\u0378x", "   lead", "x   "]:
        assert codec.encode(text) == library.encode(text), text


def test_viterbi_is_best(codec):
    def brute(segment):
        best = [0.0] + [-1e18] * len(segment)
        ids = {codec.pieces.names[i]: s for i, s in codec.pieces.score.items()}
        for j in range(1, len(segment) + 1):
            best[j] = max([best[i] + ids[segment[i:j]] for i in range(j) if segment[i:j] in ids] + [best[j - 1] + codec.pieces.unknown])
        return best[-1]

    for segment in ("▁hello", "▁&&&&&", "▁▁▁x", "▁a\u0378\u0379b", "\u0378", "▁antidisestablishment"):
        assert codec.best_path(segment)[1] == brute(segment)


def test_codec_frames(spark):
    texts = ODD + ["a▁b ▁", "▁"]
    df = docs(spark, [(i, t, None, None) for i, t in enumerate([*texts, None])])
    out = {r["doc_id"]: r for r in sentencepiece_codec.digest(df).collect()}
    assert all(r["exact"] for r in out.values()) and out[0]["n_pieces"] == 0 == out[len(texts)]["n_pieces"]
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(sentencepiece_codec.encode(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate([*texts, None])} and sentencepiece_codec.digest(df.limit(0)).count() == 0


# -- Lattice scores -------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattice():
    return lm_score.lattice(public_tokenizers.path("piece_bpe_32k.model"))


def all_segmentations(lattice, word, weight):
    """Probability and expected pieces, by brute force."""
    total, expected = 0.0, Counter()
    for cut in range(1 << (len(word) - 1)):
        parts, start = [], 0
        for i in range(1, len(word) + 1):
            if i == len(word) or cut >> (i - 1) & 1:
                parts.append(word[start:i])
                start = i
        ids = []
        for p in parts:
            ids += [lattice.id_of[p]] if p in lattice.id_of else lattice.byte_id[list(p.encode())].tolist() if len(p) == 1 else [None]
        if None not in ids:
            p = math.exp(sum(weight[i] for i in ids))
            total += p
            for i in ids:
                expected[int(i)] += p
    return math.log(total), {i: e / total for i, e in expected.items()}


@pytest.mark.parametrize("word", ["a", "the", "thhaon", "ê\u0378x", "漢😀", "&&&&"])
def test_forward_backward(lattice, word):
    arrays, single = np.zeros(lattice.none), np.zeros(lattice.none)
    log_p, expected = all_segmentations(lattice, "▁" + word, lattice.start)
    assert math.isclose(lattice.run([word], lattice.start, np.array([2.0]), arrays)[0], log_p, rel_tol=1e-9)
    assert math.isclose(lattice._single("▁" + word, lattice.start, 2.0, single), log_p, rel_tol=1e-9)
    for i, e in expected.items():
        assert math.isclose(arrays[i], 2 * e, rel_tol=1e-6, abs_tol=1e-9) and math.isclose(single[i], 2 * e, rel_tol=1e-6, abs_tol=1e-9)


def test_weights_sum_to_one(lattice):
    assert math.isclose(np.exp(lattice.start).sum(), 1.0, rel_tol=1e-9)


def test_pack():
    for codes in ([], [0], [5, 5, 1, 70000], list(range(300))):
        assert lm_score.unpack(lm_score.pack(np.array(codes, np.int64))).tolist() == sorted(codes)


def test_scores(spark, lattice, monkeypatch):
    rng = np.random.default_rng(1)
    syllables = ["th", "on", "er", "in", "ea", "Re", "é"]
    rows = [(i, " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(rng.integers(1, 30))), None, None) for i in range(120)]
    rows += [(120, None, None, None), (121, "", None, None), (122, "y" * 3000, None, None), (122, "th on", None, None), (None, "th", None, None)]
    out = lm_score.score(docs(spark, rows)).collect()
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    counts, ends = Counter(), 0
    for i, t, *_ in rows:
        if not fold(i):
            counts.update(lower(t).split())
            ends += 1
    n, v = sum(counts.values()) + ends, len(counts) + 1
    expected = sorted((str(i), fold(i), len(lower(t).split()) + 1, sum(counts[w] > 0 for w in lower(t).split()) + 1, n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in lower(t).split()) + math.log10((ends + 1) / (n + v + 1)), 6)) for i, t, *_ in rows)
    assert sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in out) == expected
    # Training raises the probability of held-out texts over the vocabulary's own scores.
    plain = lm_score.score(docs(spark, rows), rounds=0).collect()
    held = lambda rs: sum(r["score"] for r in rs if r["held_out"])
    assert held(out) > held(plain) and all(r["score"] < 0 for r in out)
    assert lm_score.score(docs(spark, [])).count() == 0


def test_scores_without_training_documents(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (r,) = lm_score.score(docs(spark, [(held, "the end", None, None)])).collect()
    assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (True, 3, 0, 0) and r["base_score"] == 0.0 and r["score"] < 0
