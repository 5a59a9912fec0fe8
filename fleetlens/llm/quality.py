"""Quality rules, and robust multivariate outliers by minimum covariance determinant per language and source."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import stored

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: Groups of fewer documents are judged with the others of their language, and those of small languages together.
MIN_GROUP = 60
#: Share of a group's documents that its estimate must cover.
COVERED = 0.6
STEPS = 6
#: Weight, in words of ordinary text, that keeps the rates of short texts near the middle.
PRIOR_WORDS = 30.0
#: Documents this improbable under the estimate are outliers.
TAIL = 1e-6
#: Spread below which a statistic says nothing (in units of the transformed statistic); keeps covariances regular.
FLOORS = (0.04, 0.08, 0.04, 0.20, 0.12, 0.12)
NAMES = ("word_length", "symbols", "capitals", "dup_lines", "repeats", "marks")
P = len(NAMES)
#: Transformed statistics are whole multiples of 1 / UNIT, so that sums do not depend on the order of the rows.
UNIT = 4096
#: Distances are ranked in bins of log2(1 + d2) / BIN.
BIN = 1 / 32

STATS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_capitals long, n_marks long"
)


def repeat_words(words: list[bytes]) -> int:
    """Words covered by windows of five words that occur twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    base, windows = len(number), ids[:n].copy()
    for k in range(1, WINDOW):
        windows = windows * base + ids[k : k + n]
        if k < WINDOW - 1 and base ** (k + 2) >= 2**62:  # number the windows so far anew before they overflow
            windows = np.unique(windows, return_inverse=True)[1]
    order = np.argsort(windows, kind="stable")
    same = np.diff(windows[order]) == 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    at = np.nonzero(twice)[0]
    np.add.at(edges, at, 1)
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def text_statistics(text: str | None) -> tuple[int, ...]:
    """Counts of a text, in the order of ``STATS``."""
    if not text:
        return (0,) * 8
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at exactly the six ASCII white space characters
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    points = np.frombuffer(raw, np.uint8)
    capitals = int(((points >= 65) & (points <= 90)).sum())
    return (
        len(words),
        len(text) - sum(text.count(c) for c in SPACES),
        sum(text.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(words),
        len(lines),
        capitals,
        sum(text.count(c) for c in ".,;:!?"),
    )


def _statistics(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_statistics(t) for t in texts], columns=[c.split()[0] for c in STATS.split(", ")])


def with_statistics(docs: DataFrame) -> DataFrame:
    """Adds the counts of ``STATS``, ``base_failed``, and the transformed statistics ``x`` as whole numbers (1 / UNIT)."""
    # else a filter on its counts is pushed below it with a call of its own: texts counted twice, two Python workers a task
    counted = F.pandas_udf(_statistics, STATS).asNondeterministic()
    docs = docs.withColumn("_s", counted(F.col("text").cast("string")))
    docs = docs.withColumns({c.split()[0]: F.col("_s")[c.split()[0]] for c in STATS.split(", ")}).drop("_s")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    n, a = F.col("n_words"), PRIOR_WORDS
    transformed = (
        F.log((F.col("word_chars") + 5 * a) / (n + a)),
        F.sqrt(F.col("n_symbols") / (n + a)),
        F.sqrt((F.col("n_capitals") + 0.1 * a) / (F.col("word_chars") + 5 * a)),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 3)),
        F.sqrt(F.col("n_repeat_words") / (n + a)),
        F.log((F.col("n_marks") + 0.15 * a) / (n + a)),
    )
    x = F.array(*[F.round(t * UNIT).cast("long") for t in transformed])
    return docs.withColumn("base_failed", failed).withColumn("x", x)


def chi2_above(x: float, dims: int) -> float:
    """P(chi-squared with an even number of dims > x)."""
    term = total = math.exp(-x / 2)
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return total


def chi2_quantile(above: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_above(mid, dims) > above else (low, mid)
    return low


@dataclass
class Model:
    """``groups``: language and source to group; ``shapes``: group to centre and inverse covariance. Both are small tables."""

    groups: DataFrame
    shapes: DataFrame


def _groups(stats: DataFrame) -> DataFrame:
    """Group of each (lang, source): its own, or that of its language's small sources, or that of all small languages."""
    sizes = stats.where("NOT base_failed").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))
    large = F.col("n") >= MIN_GROUP
    rest = Window.partitionBy("lang", large)
    pooled = F.sum("n").over(rest) >= MIN_GROUP
    name = F.when(large, F.to_json(F.struct("lang", "source"))).when(pooled, F.to_json(F.struct("lang"))).otherwise("")
    return stored(sizes.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), name.alias("g")))


def _grouped(stats: DataFrame, groups: DataFrame) -> DataFrame:
    same = stats["lang"].eqNullSafe(groups["_lang"]) & stats["source"].eqNullSafe(groups["_source"])
    return stats.join(groups, same, "left").drop("_lang", "_source")


def distance2(shape: str = "shape") -> Column:
    """Squared Mahalanobis distance of ``x`` under a shape."""
    centred = [F.col("x")[i] / float(UNIT) - F.col(f"{shape}.centre")[i] for i in range(P)]
    terms = [
        centred[i] * centred[j] * F.col(f"{shape}.inverse")[i * P + j] * (1 if i == j else 2) for i in range(P) for j in range(i, P)
    ]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.greatest(total, F.lit(0.0))


def _medians(rows: DataFrame, value: Column) -> DataFrame:
    """Median of each statistic per group, from exact counts of its whole-number values."""
    long = rows.select("g", F.posexplode(value).alias("i", "v"))
    counts = long.groupBy("g", "i", "v").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("g", "i")
    counts = counts.withColumn("upto", F.sum("n").over(of.orderBy("v"))).withColumn("all", F.sum("n").over(of))
    middle = counts.where("2 * upto >= all").groupBy("g", "i").agg(F.min("v").alias("v"))
    return middle.groupBy("g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("v"))


def _sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, sums and sums of products of the statistics: whole numbers, the same in any order."""
    x = [F.col("x")[i] for i in range(P)]
    products = [F.sum(x[i] * x[j]) for i in range(P) for j in range(i, P)]
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(v) for v in x]).alias("s"), F.array(*products).alias("ss")
    )


SHAPE = "g string, start int, centre array<double>, inverse array<double>, spread double, n long"


def _shape(n: int, s: np.ndarray, ss: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray, float]:
    centre = s / n / UNIT
    cov = np.zeros((P, P))
    cov[np.triu_indices(P)] = ss / n / UNIT**2
    cov = cov + np.triu(cov, 1).T - np.outer(centre, centre)
    cov = cov * scale + np.diag(np.square(FLOORS))
    return centre, np.linalg.inv(cov), float(np.linalg.slogdet(cov)[1])


def _fitter(share: float | None, scale: float):
    """Estimates from the bins of each group and start: those up to ``share`` of the rows, or all."""

    def fit(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values("bin")
        total = int(bins["n"].sum())
        take = len(bins)
        if share is not None:
            need = math.ceil(share * total)
            take = int(np.searchsorted(np.cumsum(bins["n"].to_numpy()), need)) + 1
        own = bins.iloc[:take]
        n = int(own["n"].sum())
        s, ss = (np.sum([np.asarray(list(v), object) for v in own[c]], axis=0).astype(float) for c in ("s", "ss"))
        centre, inverse, spread = _shape(n, s, ss, scale)
        row = (bins["g"].iloc[0], bins["start"].iloc[0], centre.tolist(), inverse.ravel().tolist(), spread, total)
        return pd.DataFrame([row], columns=["g", "start", "centre", "inverse", "spread", "n"])

    return fit


def fit(stats: DataFrame) -> Model:
    """Minimum covariance determinant estimates of every group from all its documents that pass the base rules.

    Two starts, ordering a group's rows by the sum and by the greatest of their
    squared robust z-scores; then concentration steps: the estimate from the rows
    nearest under the last one, as many bins of distance as hold the covered share.
    The start of least determinant wins; then all rows within its 97.5 % ellipsoid
    give the final estimate, each scaled to be consistent for normal data. A
    step moves sums per group and bin only, whatever the size of a group.
    """
    groups = _groups(stats)
    rows = stored(_grouped(stats.where("NOT base_failed"), groups).select("g", "x"))
    middle = stored(_medians(rows, F.col("x")).withColumnRenamed("v", "middle"))
    centred = rows.join(middle, "g")
    gaps = F.transform(F.arrays_zip("x", "middle"), lambda z: F.abs(z["x"] - z["middle"]))
    gap = stored(_medians(centred, gaps).withColumnRenamed("v", "gap"))
    z2 = [
        F.pow((F.col("x")[i] - F.col("middle")[i]) / F.sqrt(F.pow(1.4826 * F.col("gap")[i], 2.0) + (FLOORS[i] * UNIT) ** 2), 2.0)
        for i in range(P)
    ]
    order = F.array(sum(z2[1:], z2[0]), P * F.greatest(*z2))
    first = centred.join(gap, "g").select("g", "x", F.posexplode(order).alias("start", "d2"))

    def binned(frame: DataFrame) -> DataFrame:
        return frame.withColumn("bin", F.floor(F.log2(1 + F.col("d2")) / BIN).cast("int"))

    within = chi2_quantile(1 - COVERED, P)
    scale = COVERED / (1 - chi2_above(within, P + 2))
    concentrate = _fitter(COVERED, scale)
    shapes = stored(_sums(binned(first), ["g", "start", "bin"]).groupBy("g", "start").applyInPandas(concentrate, SHAPE))
    for _ in range(STEPS):
        under = rows.join(_packed(shapes), "g").withColumn("d2", distance2())
        sums = _sums(binned(under), ["g", "start", "bin"])
        shapes = stored(sums.groupBy("g", "start").applyInPandas(concentrate, SHAPE))
    best = shapes.groupBy("g").agg(F.min_by("start", F.struct("spread", "start")).alias("start"))
    shapes = stored(shapes.join(best, ["g", "start"]))
    near = chi2_quantile(0.025, P)
    inner = rows.join(_packed(shapes), "g").where(distance2() <= near).withColumn("bin", F.lit(0))
    final = _fitter(None, 0.975 / (1 - chi2_above(near, P + 2)))
    refined = _sums(inner, ["g", "start", "bin"]).groupBy("g", "start").applyInPandas(final, SHAPE)
    totals = rows.groupBy("g").agg(F.count(F.lit(1)).alias("all"))
    refined = refined.join(totals, "g").where(F.col("all") >= MIN_GROUP)
    return Model(groups, stored(_packed(refined)))


def _packed(shapes: DataFrame) -> DataFrame:
    return shapes.select("g", "start", F.struct("centre", "inverse").alias("shape"))


def judge(stats: DataFrame, model: Model, tail: float = TAIL) -> DataFrame:
    """Adds ``distance`` (squared, rounded to 4 places; null if there is no estimate) and ``kept``."""
    judged = _grouped(stats, model.groups).join(model.shapes.drop("start"), "g", "left")
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), F.round(distance2(), 4))).drop("g", "shape")
    outlier = F.coalesce(F.col("distance") > chi2_quantile(tail, P), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~outlier)


ADDED = [c.split()[0] for c in STATS.split(", ")] + ["base_failed", "x", "distance", "kept"]


def apply_rules(docs: DataFrame) -> DataFrame:
    """All columns of ``docs`` with the counts, ``base_failed``, ``distance`` and ``kept``.

    A null text has no words and fails the base rules, as do empty and blank
    ones. Null languages and sources are groups like others. Groups too small
    for an estimate, pooling included, lose nothing but what fails the base
    rules. Repeated rows count and are judged each. Columns of the added names
    are replaced, others stay. An empty table gives none.
    """
    docs = docs.drop(*ADDED, "_s", "g", "shape")
    model = fit(stored(with_statistics(docs.select("lang", "source", "text")).drop("text")))
    return judge(with_statistics(docs), model).drop("x")


def op7_query(docs: DataFrame) -> DataFrame:
    stats = stored(with_statistics(docs.select("doc_id", "lang", "source", "text")).drop("text"))
    return judge(stats, fit(stats)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance"
    )
