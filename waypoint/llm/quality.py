"""Quality rules: base limits, then robust outliers by minimum covariance determinant per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from waypoint.llm.common import WHITE, lean, stored

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_text_lines"]
SHAPE = StructType([StructField(c, LongType()) for c in STATS])
SYMBOLS = "#*$%&|<>"
#: Statistics are whole multiples of 1/SCALE; sums of them are exact, whatever the order.
SCALE = 256
#: Least standard deviation of each transformed statistic: length, word length, symbols, lines, words.
FLOORS = (0.5, 0.1, 0.5, 0.15, 0.15)
P = len(FLOORS)
#: Distances are counted in cells of 1/CELLS of a doubling.
CELLS = 32


def text_stats(text: str | None) -> tuple[int, ...]:
    """The base statistics of one text and the number of its lines that hold a word."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(WHITE)] if n else []
    repeated = 0
    if n >= 4:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        with np.errstate(over="ignore"):
            g = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
            g = (g ^ (g >> np.uint64(31))) * np.uint64(0x165667B19E3779F9) + h[2:]
        _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
        twice = count[inverse] > 1
        cover = np.zeros(n, bool)
        for k in range(3):
            cover[k : n - 2 + k] |= twice
        repeated = int(cover.sum())
    return (
        n,
        len(text) - sum(map(text.count, WHITE)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
    )


@F.arrow_udf(SHAPE)
@lean
def stats_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        rows = [text_stats(t.as_py()) for t in texts]
        yield pa.StructArray.from_arrays(
            [pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * len(STATS), STATS
        )


def base_failed(min_words: int = 50, max_repeat: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def _vector() -> list[Column]:
    """Transformed statistics, in whole units of 1/SCALE."""
    words = F.greatest("n_words", F.lit(1)).cast("double")
    chars = F.greatest("word_chars", F.lit(1)).cast("double")
    lines = F.greatest("n_text_lines", F.lit(1)).cast("double")
    parts = [F.log(words), F.log(chars / words), F.log1p(1000 * F.col("n_symbols") / chars), F.sqrt(F.col("n_dup_lines") / lines), F.sqrt(F.col("n_repeat_words") / words)]
    return [F.floor(x * SCALE + 0.5).cast("long").alias(f"z{k}") for k, x in enumerate(parts)]


def chi2_cdf(x: float, p: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = p / 2, x / 2
    term = total = math.exp(a * math.log(y) - y - math.lgamma(a + 1))
    k = 1
    while term > total * 1e-17 and k < 5000:
        term *= y / (a + k)
        total += term
        k += 1
    return min(total, 1.0)


def chi2_quantile(q: float, p: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, p) < q else (low, mid)
    return (low + high) / 2


_SUMS = [(i, j) for i in range(P) for j in range(i, P)]
_ESTIMATE = [*[f"m{k}" for k in range(P)], *[f"q{i}{j}" for i, j in _SUMS]]
_FIT = ", ".join(["cohort string", "n bigint", *[f"{c} double" for c in _ESTIMATE]])


def _matrix(t: dict[str, list], r: int) -> np.ndarray:
    out = np.empty((P, P))
    for i, j in _SUMS:
        out[i, j] = out[j, i] = t[f"q{i}{j}"][r]
    return out


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scatter of each row, with FLOORS, replaced by its inverse."""
    for batch in batches:
        t = batch.to_pydict()
        inverse = [np.linalg.inv(_matrix(t, r) + np.diag(np.square(FLOORS))) for r in range(batch.num_rows)]
        t |= {f"q{i}{j}": [float(x[i, j]) for x in inverse] for i, j in _SUMS}
        yield pa.RecordBatch.from_pydict(t, schema=batch.schema)


def _solved(factor: float):
    """From counts and exact sums of a subset: centre and scatter of each cohort."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pydict()
            rows: dict[str, list] = {name: [] for name in _ESTIMATE}
            for r in range(batch.num_rows):
                n = t["n"][r]
                for k in range(P):
                    rows[f"m{k}"].append(t[f"s{k}"][r] / n / SCALE)
                for i, j in _SUMS:  # whole numbers until the last division
                    scatter = (n * t[f"s{i}{j}"][r] - t[f"s{i}"][r] * t[f"s{j}"][r]) / (n * n)
                    rows[f"q{i}{j}"].append(factor * scatter / SCALE**2)
            yield pa.RecordBatch.from_pydict(
                {"cohort": batch.column("cohort"), "n": pa.array(t["n"], pa.int64()), **{k: pa.array(v, pa.float64()) for k, v in rows.items()}}
            )

    return run


def _distance() -> Column:
    d = [F.col(f"z{k}") / SCALE - F.col(f"m{k}") for k in range(P)]
    return sum((d[i] * d[j] * F.col(f"q{i}{j}") * (1 if i == j else 2) for i, j in _SUMS), F.lit(0.0))


def _totals(rows: DataFrame, *keys: str) -> DataFrame:
    sums = {f"s{k}": F.col(f"z{k}") for k in range(P)} | {f"s{i}{j}": F.col(f"z{i}") * F.col(f"z{j}") for i, j in _SUMS}
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()])


def _fit(totals: DataFrame, factor: float) -> DataFrame:
    return totals.mapInArrow(_solved(factor), _FIT)


def fit_cohorts(vectors: DataFrame, share: float = 0.75, steps: int = 5) -> DataFrame:
    """Minimum-covariance-determinant estimate per cohort (columns cohort, z0..): rows it rests on, centre, scatter.

    From a start at medians and median deviations, each concentration step takes, per cohort, the
    ``share`` of rows nearest by the present estimate (whole cells of the distance scale, so ties stay
    together) and estimates anew from these; the determinant falls from step to step. One step is one
    pass with map-side sums per (cohort, cell of distance), at most some thousand rows per cohort and
    task, so a cohort may hold any share of the rows. All sums are of whole numbers and exact: the
    estimate does not depend on partitioning or retries. A last step takes all rows within the 97.5 %
    ellipsoid. Distances take the scatter with ``FLOORS`` squared on its diagonal: a statistic may be
    constant in a cohort, and spread below the floors is no sign of junk in any.
    """
    q = chi2_quantile(share, P)
    trimmed = share / chi2_cdf(q, P + 2)
    q_last = chi2_quantile(0.975, P)
    # medians of at most some thousand different whole numbers each: the buffers of percentile are bounded
    middle = vectors.groupBy("cohort").agg(*[F.percentile(f"z{k}", 0.5).alias(f"c{k}") for k in range(P)])
    off = vectors.join(middle, "cohort").groupBy("cohort").agg(
        *[F.percentile(F.abs(F.col(f"z{k}") - F.col(f"c{k}")), 0.5).alias(f"a{k}") for k in range(P)]
    )
    start = middle.join(off, "cohort").select(
        "cohort",
        *[(F.col(f"c{k}") / SCALE).alias(f"m{k}") for k in range(P)],
        *[(1 / (F.pow(1.4826 * F.col(f"a{i}") / SCALE, 2) + FLOORS[i] ** 2) if i == j else F.lit(0.0)).alias(f"q{i}{j}") for i, j in _SUMS],
    )
    fit = stored(start, "mcd")
    cell = F.floor(F.log2(_distance() + 1e-6) * CELLS).cast("int")
    for _ in range(steps):
        by_cell = _totals(vectors.join(fit.select("cohort", *_ESTIMATE), "cohort").withColumn("cell", cell), "cohort", "cell")
        below = Window.partitionBy("cohort").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        nearest = by_cell.withColumns(
            {"before": F.coalesce(F.sum("n").over(below), F.lit(0)), "all": F.sum("n").over(Window.partitionBy("cohort"))}
        ).where(F.col("before") < F.ceil(F.col("all") * share))
        sums = [c for c in by_cell.columns if c not in ("cohort", "cell")]
        found = _fit(nearest.groupBy("cohort").agg(*[F.sum(c).alias(c) for c in sums]), trimmed)
        fit = stored(found.mapInArrow(_inverted, _FIT), "mcd")
    inside = vectors.join(fit.select("cohort", *_ESTIMATE), "cohort").where(_distance() <= q_last)
    return stored(_fit(_totals(inside, "cohort"), 0.975 / chi2_cdf(q_last, P + 2)), "mcd")


def _shrunk(own: DataFrame, wide: DataFrame, key: str, strength: int) -> DataFrame:
    """Estimates drawn towards those of the wider cohort named by ``key``, with ``strength`` rows' weight."""
    w = F.col("n") / (F.col("n") + strength)
    towards = wide.select(F.col("cohort").alias(key), *[F.col(c).alias(f"_{c}") for c in _ESTIMATE])
    return own.join(towards, key).withColumns({c: w * F.col(c) + (1 - w) * F.col(f"_{c}") for c in _ESTIMATE}).drop(*[f"_{c}" for c in _ESTIMATE])


def _cell_of(lang: str, source: str) -> Column:
    none = F.lit("\x00")
    return F.concat(F.coalesce(F.col(lang).cast("string"), none), F.lit("\x1f"), F.coalesce(F.col(source).cast("string"), none))


def fit_quality(
    stats: DataFrame, lang: str = "lang", source: str = "source", strength: int = 5 * P, share: float = 0.75, steps: int = 5
) -> DataFrame:
    """Estimates for every (language, source) among the rows that pass the base limits.

    Each pair, each language and the whole table have an estimate of their own, whatever their size. A
    scatter of five statistics needs rows, some five each: the estimate of a pair that rests on n rows
    counts n / (n + ``strength``), the rest of the weight is its language's, which is drawn towards the
    whole likewise. So there is no size at which the method changes; with 1000 rows the pair itself
    decides by 0.976, and a lone row is judged by its language. Null language or source is a value of its own.
    """
    lang_of = F.concat(F.lit("l:"), F.coalesce(F.col(lang).cast("string"), F.lit("\x00")))
    pair_of = F.concat(F.lit("p:"), _cell_of(lang, source))
    rows = stored(stats.where(~base_failed()).select(pair_of.alias("pair"), lang_of.alias("l"), *_vector()), "vectors")
    names = stored(rows.select("pair", "l").distinct().withColumn("wide", F.lit("all")), "pairs")
    levels = rows.select(F.explode(F.array(F.lit("all"), "l", "pair")).alias("cohort"), *[f"z{k}" for k in range(P)])
    fits = fit_cohorts(levels, share, steps)
    languages = names.select(F.col("l").alias("cohort"), "wide").distinct().join(fits, "cohort")
    languages = _shrunk(languages, fits, "wide", strength)
    pairs = _shrunk(names.withColumnRenamed("pair", "cohort").join(fits, "cohort"), languages, "l", strength)
    pairs = pairs.select("cohort", "n", *_ESTIMATE).mapInArrow(_inverted, _FIT)
    return stored(pairs.select(F.expr("substring(cohort, 3)").alias("_q_pair"), *_ESTIMATE), "fits")


def judged(stats: DataFrame, fits: DataFrame, lang: str = "lang", source: str = "source", tail: float = 1e-6) -> DataFrame:
    """Adds base_failed, distance (squared, null where the base limits fail) and kept."""
    cutoff = chi2_quantile(1 - tail, P)
    z = stats.withColumns({f"z{k}": c for k, c in enumerate(_vector())}).withColumn("_q_key", _cell_of(lang, source))
    z = z.join(fits, F.col("_q_key") == F.col("_q_pair"), "left")
    failed = base_failed()
    z = z.withColumns({"base_failed": failed, "distance": F.when(~failed, _distance())})
    return z.withColumn("kept", ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= cutoff)).drop(
        "_q_key", *fits.columns, *[f"z{k}" for k in range(P)]
    )


def quality_report(docs: DataFrame, tail: float = 1e-6, share: float = 0.75, steps: int = 5) -> DataFrame:
    """doc_id, the base statistics, base_failed, distance and kept of every row.

    Base limits: fewer than 50 words, or over half of the words in repeated three-word windows. Rows
    that pass are rejected if the squared Mahalanobis distance of (log words, log word length, log
    symbol share, root of repeated lines, root of repeated words) from the robust centre of their
    language and source (``fit_quality``) exceeds the chi-squared quantile of ``1 - tail``.

    Defined cases: null text has no words and fails; null language or source is a value of its own;
    repeated rows count each; an empty table gives an empty table; other columns are not read.
    """
    own = docs.select("doc_id", "lang", "source", stats_of("text").alias("_q_s"))
    own = stored(own.select("doc_id", "lang", "source", *[F.col(f"_q_s.{c}").alias(c) for c in STATS]), "stats")
    out = judged(own, fit_quality(own, share=share, steps=steps), tail=tail)
    return out.select("doc_id", *STATS[:5], "base_failed", "kept", "distance")


def keep_good(docs: DataFrame, tail: float = 1e-6, share: float = 0.75, steps: int = 5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns (``_q_`` names are reserved)."""
    narrow = docs.select("lang", "source", stats_of("text").alias("_q_s"))
    narrow = stored(narrow.select("lang", "source", *[F.col(f"_q_s.{c}").alias(c) for c in STATS]), "stats")
    fits = fit_quality(narrow, share=share, steps=steps)
    own = docs.withColumn("_q_s", stats_of("text")).select(F.struct(*docs.columns).alias("_q_doc"), "lang", "source", *[F.col(f"_q_s.{c}").alias(c) for c in STATS])
    return judged(own, fits, tail=tail).where("kept").select("_q_doc.*")
