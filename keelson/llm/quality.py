"""Quality rules by robust multivariate outliers: minimum covariance determinant for each language and source.

A document's statistics become a vector of transformed ratios. For each (language, source), and for all rows together, the
minimum covariance determinant estimate of location and scatter is sought from three starts over all rows: medians with median
deviations, and these with the correlations of tanh scores or of spatial signs. From each start, concentration steps fit the
nearest three quarters again and again; the fit of the least determinant wins, and is reweighted. Documents whose Mahalanobis
distance is beyond the cutoff are rejected.

A step is two aggregations: a histogram of distances gives the cut, sums below the cut give the fit. The nearest part is cut
at a 64th of an octave of the squared distance: it holds all of the nearest three quarters, and what lies up to 1.1 % farther.
Rows are summed where they are, before anything is shuffled, so no group meets in one task, however large: fits come to them
by a broadcast of checked size, or else by a join on group and salt.

Groups with few documents use the fit over all groups. Defined cases: null text has no words and fails the base rules; null
language and source form groups like any other value; very long texts are measured in whole; repeated rows are judged alike;
equal distances (ties) fall on one side of a cut; an empty table gives an empty result; other columns pass through
`keep_documents` untouched, whatever their names, and are not read by `judge`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from ._text import Block, blocks, byte_set, mix, prefix_hashes, shingles, span_hashes

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct")
SYMBOLS, UPPER = byte_set(b"#*$%&|<>"), byte_set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
PUNCT = byte_set(b"!\"'()+,-./:;=?@[\\]^_`{}~")
#: The vector: shares on the arcsine scale, and the logarithm of the mean length of a word.
FEATURES = ("symbols", "dup_lines", "repeats", "upper", "punct", "length")
D = len(FEATURES)
#: Least standard deviation of each feature: spreads below it are taken for it, so that rare harmless variation (a short
#: text with one repeated line, where others have none) is no outlier.
LEAST_SD = (0.04, 0.12, 0.12, 0.04, 0.04, 0.05)
COVERAGE, STEPS, LEAST_ROWS = 0.75, 3, 200
#: The chance that a document of the fitted distribution is rejected.
REJECT = 1e-9
#: Distances fall in bins of a 64th of a power of two (of the squared distance).
BINS_PER_OCTAVE = 64
#: Fits up to so many bytes are broadcast, beyond that joined by group and one of SALTS salts.
BROADCAST_BYTES, FIT_BYTES, SALTS = 8 << 20, 512, 64
STARTS = 3


def base_statistics(block: Block) -> np.ndarray:
    """Rows: documents; columns: STATS."""
    starts, ends, first = block.words()
    prefix = prefix_hashes(block.data)
    doc = np.repeat(np.arange(block.n), np.diff(first))
    out = np.zeros((block.n, len(STATS)), np.int64)
    out[:, 0] = np.diff(first)
    inside = np.zeros(len(block.data) + 1, np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out[:, 1] = block.sums(inside & ((block.data & 0xC0) != 0x80))
    out[:, 2] = block.sums(SYMBOLS[block.data])
    line_start, line_end, line_doc = block.lines()
    worded = np.searchsorted(starts, line_end) > np.searchsorted(starts, line_start)
    line_start, line_end, line_doc = line_start[worded], line_end[worded], line_doc[worded]
    out[:, 5] = np.bincount(line_doc, minlength=block.n)
    _, at = np.unique(mix(span_hashes(prefix, line_start, line_end) ^ mix(line_doc.astype(np.uint64))), return_index=True)
    out[:, 3] = out[:, 5] - np.bincount(line_doc[at], minlength=block.n)
    windows = shingles(span_hashes(prefix, starts, ends), 3)
    if len(windows):
        at = np.flatnonzero(doc[:-2] == doc[2:])
        keys = mix(windows[at] ^ mix(doc[at].astype(np.uint64)))
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(doc), bool)
        twice[at[order[1:][same]]] = True
        twice[at[order[:-1][same]]] = True
        covered = twice.copy()
        covered[1:] |= twice[:-1]
        covered[2:] |= twice[:-2]
        out[:, 4] = np.bincount(doc[covered], minlength=block.n)
    out[:, 6] = block.sums(UPPER[block.data])
    out[:, 7] = block.sums(PUNCT[block.data])
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the last column, the text, by the statistics."""
    for batch in batches:
        got = [base_statistics(b) for b in blocks(batch.column(batch.num_columns - 1))]
        rows = np.concatenate(got) if got else np.zeros((0, len(STATS)), np.int64)
        columns = batch.columns[:-1] + [pa.array(rows[:, i]) for i in range(len(STATS))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], *STATS])


def _with_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add the statistics of the last column, a copy of the text, in its place."""
    return _statistics(batches)


def _schema(df: DataFrame) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), *(f"{s} bigint" for s in STATS)])


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id, grp (language and source), STATS; a row per document."""
    grp = F.to_json(F.struct(F.col(lang_col).cast("string").alias("l"), F.col(source_col).cast("string").alias("s")))
    narrow = docs.select(F.col(id_col).alias("id"), grp.alias("grp"))
    return docs.select(F.col(id_col).alias("id"), grp.alias("grp"), F.col(text_col).alias("text")).mapInArrow(_statistics, _schema(narrow))


def base_failed() -> Column:
    return F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")


def features() -> list[Column]:
    share = lambda a, b: F.expr(f"asin(sqrt(least(1D, {a} / greatest(1, {b}))))")
    return [
        share("n_symbols", "(n_symbols + word_chars)"),
        share("n_dup_lines", "n_lines"),
        share("n_repeat_words", "n_words"),
        share("n_upper", "word_chars"),
        share("n_punct", "word_chars"),
        F.expr("ln(greatest(1, word_chars) / greatest(1, n_words))"),
    ]


def _distance() -> Column:
    """Squared Mahalanobis distance from `mu`, with the inverse scatter `inv` by rows."""
    c = [F.col(f"x{i}") - F.col("mu")[i] for i in range(D)]
    total = F.lit(0.0)
    for i in range(D):
        row = F.lit(0.0)
        for j in range(D):
            row = row + F.col("inv")[i * D + j] * c[j]
        total = total + c[i] * row
    return F.greatest(F.lit(0.0), total)


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function, by its series."""
    if x <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi2_cdf(x: float, d: int) -> float:
    return gamma_p(d / 2, x / 2)


def chi2_quantile(p: float, d: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, d) < p else (lo, mid)
    return hi


def consistency(p: float) -> float:
    """What the scatter of the nearest part p of a normal distribution must be multiplied by."""
    return p / chi2_cdf(chi2_quantile(p, D), D + 2)


def regularised(scatter: np.ndarray) -> tuple[np.ndarray, float]:
    """The inverse, and the logarithm of the determinant, of a scatter with at least the least deviations."""
    scale = np.outer(LEAST_SD, LEAST_SD)
    values, vectors = np.linalg.eigh(scatter / scale)
    values = np.maximum(values, 1.0)
    return (vectors / values) @ vectors.T / scale, float(np.log(values).sum())


def _correlation(scatter: np.ndarray) -> np.ndarray:
    spread = np.sqrt(np.diag(scatter))
    out = scatter / np.maximum(np.outer(spread, spread), 1e-300)
    np.fill_diagonal(out, 1.0)
    return out


def starting_scatters(n: float, scale: np.ndarray, tanh: np.ndarray, tanh_squares: np.ndarray, sign_squares: np.ndarray) -> list[np.ndarray]:
    """The scatter of each start, from sums over the n rows of a group (of rows less their medians, by `scale`)."""
    mean = tanh / n
    return [r * np.outer(scale, scale) for r in (np.eye(D), _correlation(tanh_squares / n - np.outer(mean, mean)), _correlation(sign_squares / n))]


FIT = "grp string, start int, mu array<double>, inv array<double>, log_det double"
FIT_NAMES = ["grp", "start", "mu", "inv", "log_det"]


def _start(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for row in frame.itertuples(index=False):
            square = lambda x: np.array(x).reshape(D, D)
            for k, scatter in enumerate(starting_scatters(row.n, np.array(row.scale), np.array(row.tanh), square(row.tanh_squares), square(row.sign_squares))):
                inv, log_det = regularised(scatter)
                out.append((row.grp, k, list(row.mid), inv.ravel().tolist(), log_det))
        yield pd.DataFrame(out, columns=FIT_NAMES)


def _solve(part: float):
    """From sums of rows to fits: location, inverse scatter and its determinant."""
    scale = consistency(part)

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                mu = np.array(row.sums) / row.n
                inv, log_det = regularised((np.array(row.squares).reshape(D, D) / row.n - np.outer(mu, mu)) * scale)
                out.append((row.grp, row.start, mu.tolist(), inv.ravel().tolist(), log_det))
            yield pd.DataFrame(out, columns=FIT_NAMES)

    return fit


def _with_fits(rows: DataFrame, fits: DataFrame, how: str = "inner") -> DataFrame:
    """Join fits (materialized; by grp, several of one grp where there are several starts) without moving rows by group."""
    if fits.count() * FIT_BYTES <= BROADCAST_BYTES:
        return rows.join(F.broadcast(fits), "grp", how)
    salted = fits.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(*[c for c in rows.columns if c != "doc"]), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt).join(salted, ["grp", "__salt"], how).drop("__salt")


def fit(stats: DataFrame) -> DataFrame:
    """grp, mu, inv for each group with enough rows, and for all rows together as group ''.

    stats: grp, STATS; only rows that pass the base rules take part.
    """
    xs = [f"x{i}" for i in range(D)]
    pair = [(i, j) for i in range(D) for j in range(D)]
    rows = stats.where(~base_failed()).select("grp", *[c.alias(x) for c, x in zip(features(), xs, strict=True)])
    rows = materialize(rows, "quality-vectors").withColumn("grp", F.explode(F.array("grp", F.lit(""))))
    # Medians, and median deviations.
    middle = rows.groupBy("grp").agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.percentile_approx(x, 0.5, 1000) for x in xs]).alias("mid"))
    middle = materialize(middle.where((F.col("n") >= LEAST_ROWS) | (F.col("grp") == "")), "quality-medians")
    off = [F.col(x) - F.col("mid")[i] for i, x in enumerate(xs)]
    spread = [F.greatest(F.percentile_approx(F.abs(o), 0.5, 1000) * 1.4826, F.lit(sd)) for o, sd in zip(off, LEAST_SD, strict=True)]
    scales = materialize(_with_fits(rows, middle).groupBy("grp").agg(F.first("n").alias("n"), F.first("mid").alias("mid"), F.array(*spread).alias("scale")), "quality-scales")
    z = _with_fits(rows, scales).select("grp", "n", "mid", "scale", *[(o / F.col("scale")[i]).alias(f"z{i}") for i, o in enumerate(off)])
    z = z.withColumn("length2", F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(D)), F.lit(0.0)), F.lit(1e-18)))
    z = z.withColumns({f"t{i}": F.tanh(f"z{i}") for i in range(D)})
    sums = z.groupBy("grp").agg(
        F.first("n").alias("n"), F.first("mid").alias("mid"), F.first("scale").alias("scale"), F.array(*[F.sum(f"t{i}") for i in range(D)]).alias("tanh"),
        F.array(*[F.sum(F.col(f"t{i}") * F.col(f"t{j}")) for i, j in pair]).alias("tanh_squares"), F.array(*[F.sum(F.col(f"z{i}") * F.col(f"z{j}") / F.col("length2")) for i, j in pair]).alias("sign_squares"),
    )
    fits = materialize(sums.mapInPandas(_start, FIT), "quality-fits")
    for step in range(STEPS + 1):
        near = _with_fits(rows, fits).select("grp", "start", *xs, _distance().alias("d2"))
        if step < STEPS:
            part = COVERAGE
            bin_ = F.floor(F.log2(F.greatest(F.col("d2"), F.lit(1e-9))) * BINS_PER_OCTAVE)
            bins = near.groupBy("grp", "start", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            own = Window.partitionBy("grp", "start")
            bins = bins.withColumns({"upto": F.sum("n").over(own.orderBy("bin")), "all": F.sum("n").over(own)})
            cuts = materialize(bins.where(F.col("upto") >= part * F.col("all")).groupBy("grp", "start").agg(F.min("bin").alias("cut")), "quality-cuts")
            cut_fits = materialize(fits.join(cuts, ["grp", "start"]), "quality-cut-fits")
            near = _with_fits(rows, cut_fits).select("grp", "start", "cut", *xs, _distance().alias("d2")).where(bin_ <= F.col("cut"))
        else:
            part = 0.975
            near = near.where(F.col("d2") <= chi2_quantile(part, D))
        sums = near.groupBy("grp", "start").agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(x) for x in xs]).alias("sums"), F.array(*[F.sum(F.col(xs[i]) * F.col(xs[j])) for i, j in pair]).alias("squares"))
        fits = materialize(sums.mapInPandas(_solve(part), FIT), "quality-fits")
        if step == STEPS - 1:
            # Of the starts, that of the least determinant.
            best = fits.groupBy("grp").agg(F.min(F.struct("log_det", "start", "mu", "inv")).alias("best"))
            fits = materialize(best.select("grp", "best.start", "best.mu", "best.inv", "best.log_det"), "quality-best")
    return fits.select("grp", "mu", "inv")


def _verdicts(stats: DataFrame, fits: DataFrame) -> DataFrame:
    """Add base_failed, distance (squared) and kept to rows with `grp` and STATS."""
    pooled = fits.where("grp = ''").select(F.col("mu").alias("mu_all"), F.col("inv").alias("inv_all")).first()
    own = _with_fits(stats, materialize(fits, "quality-final"), "left")
    if pooled is None:
        own = own.withColumns({"mu": F.array(*[F.lit(0.0)] * D), "inv": F.array(*[F.lit(0.0)] * D * D)})
    else:
        fallback = lambda name: F.coalesce(name, F.array(*[F.lit(float(x)) for x in pooled[f"{name}_all"]]))
        own = own.withColumns({"mu": fallback("mu"), "inv": fallback("inv")})
    own = own.withColumns({f"x{i}": c for i, c in enumerate(features())})
    own = own.withColumn("base_failed", base_failed()).withColumn("distance", _distance())
    kept = ~F.col("base_failed") & (F.col("distance") <= chi2_quantile(1 - REJECT, D))
    return own.withColumn("kept", kept).drop("mu", "inv", *[f"x{i}" for i in range(D)])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, STATS, base_failed, distance (squared Mahalanobis), kept."""
    stats = materialize(statistics(docs, id_col, text_col, lang_col, source_col), "quality-stats")
    return _verdicts(stats, fit(stats)).drop("grp").withColumnRenamed("id", id_col)


def keep_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns.

    The statistics are taken again beside the texts, rather than moving texts to meet their verdicts.
    """
    grp = F.to_json(F.struct(F.col(lang_col).cast("string").alias("l"), F.col(source_col).cast("string").alias("s")))
    stats = docs.select(grp.alias("grp"), F.col(text_col).alias("text"))
    stats = materialize(stats.mapInArrow(_statistics, _schema(stats.select("grp"))), "quality-stats")
    # Columns of the input travel as one struct, so that none of their names can clash.
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), grp.alias("grp"))
    beside = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), grp.alias("grp"), F.col(text_col).alias("text"))
    rows = beside.mapInArrow(_with_statistics, _schema(whole))
    return _verdicts(rows, fit(stats)).where("kept").select("doc.*")
