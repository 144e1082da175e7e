"""Quality rules: plain counts of a text, and robust multivariate outliers among them.

Words are runs of characters other than blanks (0x20, 0x09-0x0D). Null texts
have no words. Rows are judged one by one: repeated rows get the same verdict,
null ids pass through. A null ``lang`` or ``source`` is a value of its own. Extra
columns are ignored, whatever their names are. An empty table gives an
empty result. Memory grows with the longest text: about its own size and forty
bytes a word.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from stationflow.operators.joins import spread_join

from .common import small_batches, staged
from .rows import SPACE, count_of, pieces

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50
# Components of a vector, and the spread that each has at the least: also where most texts agree, a
# difference below it says nothing.
COMPONENTS = ("log_words", "log_word_length", "root_symbols", "dup_lines", "repeat_words")
LEAST_SPREAD = (0.5, 0.05, 0.03, 0.1, 0.1)
P = len(COMPONENTS)
UNIT = 512
LEAST_GROUP = 100
CELL_ROWS = 1_000_000
OCTAVE_BINS = 16
MOST_STEPS = 30
REWEIGHT = 0.975
OUTLIER_SHARE = 1e-6
_PAIRS = list(combinations_with_replacement(range(P), 2))
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def repeated_words(hashes: np.ndarray) -> int:
    """How many words lie in three-word windows that the text holds twice or more."""
    if len(hashes) < 4:
        return 0
    with np.errstate(over="ignore"):
        run = hashes[:-2] * _C1
        run ^= run >> np.uint64(29)
        run = (run + hashes[1:-1]) * _C2
        run ^= run >> np.uint64(32)
        run = (run + hashes[2:]) * _C1
        run ^= run >> np.uint64(29)
    ranked = np.sort(run)
    twice = ranked[1:][ranked[1:] == ranked[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, run)
    hit = np.zeros(len(hashes), dtype=bool)
    hit[: len(run)] = twice[np.minimum(at, len(twice) - 1)] == run
    covered = hit.copy()
    covered[1:] |= hit[:-1]
    covered[2:] |= hit[:-2]
    return int(covered.sum())


def repeated_lines(data: bytes) -> int:
    """How many lines with a word equal an earlier line."""
    seen: set[bytes] = set()
    n = 0
    for line in io.BytesIO(data):
        line = line.removesuffix(b"\n")
        if line.strip(SPACE):
            n += line in seen
            seen.add(line)
    return n


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words word_chars n_symbols n_dup_lines n_repeat_words`` of a whole text."""
    data = (text or "").encode("utf-8", "replace")
    hashes = [np.fromiter((hash(w) for w in part.split()), dtype=np.int64) for part in pieces(data)]
    words = np.concatenate(hashes).view(np.uint64) if hashes else np.empty(0, dtype=np.uint64)
    return (
        len(words), len(text or "") - count_of(data, SPACE), count_of(data, SYMBOLS), repeated_lines(data), repeated_words(words)
    )


def vectors(n: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Statistic vectors of rows of counts, as whole numbers of 1 / ``UNIT``, so that their sums are exact.

    Logarithms of the number of words and of their mean length, the root of
    the share of symbols, shares of repeated lines and of repeated words.
    """
    words, chars, symbols, dup, again = (n[:, i].astype(np.float64) for i in range(5))
    some = np.maximum(words, 1)
    x = np.stack([
        np.log1p(words), np.log1p(chars / some), np.sqrt(symbols / np.maximum(chars, 1)), dup / np.maximum(lines, 1), again / some
    ], axis=1)
    return np.rint(x * UNIT).astype(np.int32)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        n = np.array([counts(t) for t in texts], dtype=np.int64).reshape(-1, 5)
        x = vectors(n, np.array([(t or "").count("\n") + 1 for t in texts], dtype=np.float64))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), *(pa.array(n[:, i]) for i in range(5)), *(pa.array(x[:, i]) for i in range(P))],
            names=["doc_id", "key", *_NAMES, *(f"x{i}" for i in range(P))],
        )


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id key``, the counts, the vector ``x0`` ... and ``base_failed`` of every text; ``key`` names language and source."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.to_json(F.struct(F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))).alias("key"),
        F.col("text").cast("string").alias("text"),
    )
    schema = "doc_id long, key string, " + ", ".join(f"{c} long" for c in _NAMES) + ", " + ", ".join(f"x{i} int" for i in range(P))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.mapInArrow(_measure, schema).withColumn("base_failed", failed)


def chi2_share(x: float, p: int) -> float:
    """Share of a chi-squared distribution with ``p`` degrees of freedom up to ``x``."""
    if x <= 0:
        return 0.0
    a, half = p / 2, x / 2
    if half > a + 40 * (1 + math.sqrt(a)):
        return 1.0
    term = total = 1 / a
    k = a
    while term > total * 1e-17:
        k += 1
        term *= half / k
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi2_limit(share: float, p: int) -> float:
    """The value below which this share lies."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_share(mid, p) < share else (low, mid)
    return (low + high) / 2


def consistency(share: float, p: int = P) -> float:
    """What the covariance of the nearest ``share`` of normal rows is multiplied by to be that of all rows."""
    share = min(share, 1.0)
    return 1.0 if share == 1.0 else share / chi2_share(chi2_limit(share, p), p + 2)


def from_sums(n: int, sums: np.ndarray, squares: np.ndarray, share: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Centre and covariance from the sums and summed products of ``n`` rows that are the nearest ``share``."""
    mean = sums / n
    cov = np.zeros((P, P))
    for (i, j), q in zip(_PAIRS, squares):
        cov[i, j] = cov[j, i] = (int(q) * n - int(sums[i]) * int(sums[j])) / (n * n)  # whole numbers, no cancellation
    return mean, cov * consistency(share) + np.diag((np.array(LEAST_SPREAD) * UNIT) ** 2)


_MODEL = ", ".join([*(f"m{i} double" for i in range(P)), *(f"w{k} double" for k in range(len(_PAIRS))), "det double"])
_SUMS = [*(f"s{i}" for i in range(P)), *(f"q{k}" for k in range(len(_PAIRS)))]


def _model(mean: np.ndarray, cov: np.ndarray) -> dict[str, float]:
    """Columns of an estimate: centre, weights of the products of deviations, log determinant."""
    inverse = np.linalg.inv(cov)
    out = {f"m{i}": float(mean[i]) for i in range(P)}
    out |= {f"w{k}": float(inverse[i, j] * (1 if i == j else 2)) for k, (i, j) in enumerate(_PAIRS)}
    return out | {"det": float(np.linalg.slogdet(cov)[1])}


def distance() -> Column:
    """Squared Mahalanobis distance of a row's vector from the estimate beside it."""
    parts = [
        F.col(f"w{k}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}")) for k, (i, j) in enumerate(_PAIRS)
    ]
    total = parts[0]
    for part in parts[1:]:
        total = total + part
    return F.when(total < 0, 0.0).otherwise(total)


def _sums(x=lambda i: F.col(f"x{i}").cast("long"), s: str = "s", q: str = "q") -> list[Column]:
    return [F.sum(x(i)).alias(f"{s}{i}") for i in range(P)] + [F.sum(x(i) * x(j)).alias(f"{q}{k}") for k, (i, j) in enumerate(_PAIRS)]


def _numbers(row: pd.Series, names: list[str]) -> np.ndarray:
    return np.array([int(row[c]) for c in names], dtype=object)


def _starts(pdf: pd.DataFrame) -> pd.DataFrame:
    """Three estimates to start from: median and deviation, mean and covariance, median and signs."""
    r = pdf.iloc[0]
    median = np.array([r[f"c{i}"] for i in range(P)], dtype=float)
    floor = np.array(LEAST_SPREAD) * UNIT
    spread = np.sqrt((1.4826 * np.array([r[f"d{i}"] for i in range(P)], dtype=float)) ** 2 + floor**2)
    mean, cov = from_sums(int(r["n"]), _numbers(r, _SUMS[:P]), _numbers(r, _SUMS[P:]))
    signs = np.zeros((P, P))
    for k, (i, j) in enumerate(_PAIRS):
        signs[i, j] = signs[j, i] = r[f"v{k}"] / r["n"] / UNIT**2
    signs = np.outer(spread, spread) * (signs + np.eye(P) / 100)
    found = [(median, np.diag(spread**2)), (mean, cov), (median, signs)]
    return pd.DataFrame([{"gid": r["gid"], "start": k, "n": r["n"], **_model(m, c), "det": np.inf, "done": False} for k, (m, c) in enumerate(found)])


def _concentrate(one: bool):
    """A C-step: the estimate of the nearest half of the rows; with ``one``, only the start of the least determinant goes on."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for start, own in pdf.groupby("start"):
            own = own.sort_values("bin", kind="stable")
            old = own.iloc[0]
            upto = own["rows"].cumsum().to_numpy()
            last = int(np.searchsorted(upto, (int(old["n"]) + P + 2) // 2))
            n = int(upto[min(last, len(upto) - 1)])
            half = own.iloc[: last + 1]
            total = lambda c: sum(int(v) for v in half[c])
            sums, squares = (np.array([total(c) for c in cs], dtype=object) for cs in (_SUMS[:P], _SUMS[P:]))
            new = _model(*from_sums(n, sums, squares, n / int(old["n"])))
            kept = {c: old[c] for c in new} if old["done"] or new["det"] >= old["det"] - 1e-9 else new
            out.append({"gid": old["gid"], "start": int(start), "n": int(old["n"]), **kept, "done": bool(old["done"] or kept is not new)})
        out.sort(key=lambda m: (m["det"], m["start"]))
        return pd.DataFrame(out[:1] if one else out)

    return run


def _reweigh(pdf: pd.DataFrame) -> pd.DataFrame:
    """The estimate of the rows within the ``REWEIGHT`` limit; the raw one where these are fewer than half."""
    r = pdf.iloc[0]
    n, rows = int(r["n"]), int(r["rows"])
    new = _model(*from_sums(rows, _numbers(r, _SUMS[:P]), _numbers(r, _SUMS[P:]), REWEIGHT)) if 2 * rows >= n else {c: r[c] for c in _model_names()}
    return pd.DataFrame([{"gid": r["gid"], **new}])


def _model_names() -> list[str]:
    return [f"m{i}" for i in range(P)] + [f"w{k}" for k in range(len(_PAIRS))] + ["det"]


def groups(rows: DataFrame, least: int = LEAST_GROUP) -> DataFrame:
    """``key gid n``: the group whose estimate judges each language and source, with its rows.

    Sources with fewer than ``least`` rows are pooled by language, languages whose pool is
    smaller in one pool of all; if that is too small too, ``gid`` is null.
    """
    sized = rows.groupBy("key").agg(F.count("*").alias("n")).withColumn("lang", F.get_json_object("key", "$.lang"))
    few = F.col("n") < least
    pool = F.concat(F.lit("lang "), F.to_json(F.struct("lang")))
    pools = sized.where(few).groupBy(pool.alias("pool")).agg(F.sum("n").alias("of_lang"))
    sized = sized.withColumn("pool", F.when(few, pool)).join(pools, "pool", "left")
    gid = F.when(F.col("pool").isNull(), F.col("key")).when(F.col("of_lang") >= least, F.col("pool")).otherwise("all")
    sized = staged(sized.select("key", "n", gid.alias("gid")), "sources")
    whole = sized.groupBy("gid").agg(F.sum("n").alias("of_group")).where(F.col("of_group") >= least)
    return staged(sized.drop("n").join(whole, "gid", "left").select("key", F.when(F.col("of_group").isNotNull(), F.col("gid")).alias("gid"), F.col("of_group").alias("n")), "groups")


def estimate(cells: DataFrame) -> DataFrame:
    """Minimum-covariance-determinant estimates of each ``gid``: ``gid`` and the columns of a model.

    ``cells`` (``gid cell n x0`` ...) has every row with its group's size; a cell is
    a part of a group of bounded size. Three starts take two
    C-steps, the best goes on until its determinant falls no further. A
    C-step sums the rows by group and by bins of their distance, and takes
    whole bins until they hold half of the rows. Sums are of whole
    numbers, so results do not depend on the layout of the data. The last
    step estimates again from all rows within the ``REWEIGHT`` limit.
    """
    middle = cells.groupBy("gid").agg(F.max("n").alias("n"), *[F.percentile(f"x{i}", 0.5).alias(f"c{i}") for i in range(P)])
    middle = staged(middle, "medians")

    def beside(model: DataFrame) -> DataFrame:
        parts = model.withColumn("cell", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / CELL_ROWS).cast("int"))))
        return cells.drop("n").join(parts, ["gid", "cell"])

    off = [F.abs(F.col(f"x{i}") - F.col(f"c{i}")) for i in range(P)]
    spread = beside(middle).groupBy("gid").agg(*[F.percentile(off[i], 0.5).alias(f"d{i}") for i in range(P)])
    middle = staged(middle.join(spread, "gid"), "spreads")
    own = [
        (F.col(f"x{i}") - F.col(f"c{i}")) / F.sqrt((1.4826 * F.col(f"d{i}")) ** 2 + (LEAST_SPREAD[i] * UNIT) ** 2) for i in range(P)
    ]
    size = F.sqrt(sum((z * z for z in own[1:]), own[0] * own[0]))
    signs = beside(middle)
    for i in range(P):
        signs = signs.withColumn(f"u{i}", F.when(size > 0, F.rint(own[i] / size * UNIT)).otherwise(0).cast("long"))
    totals = signs.groupBy("gid").agg(*_sums(), *_sums(lambda i: F.col(f"u{i}"), "u", "v"))
    schema = f"gid string, start int, n long, {_MODEL}, done boolean"
    model = staged(middle.join(totals, "gid").groupBy("gid").applyInPandas(_starts, schema), "starts")

    name = F.floor(OCTAVE_BINS * F.log2(F.greatest(distance(), F.lit(2.0**-8)))).cast("int")
    for step in range(MOST_STEPS):
        binned = beside(model).withColumn("bin", name).groupBy("gid", "start", "bin").agg(F.count("*").alias("rows"), *_sums())
        joined = binned.join(model, ["gid", "start"])
        model = staged(joined.groupBy("gid").applyInPandas(_concentrate(step > 0), schema), f"step{step}")
        if step > 0 and model.where("NOT done").isEmpty():
            break
    near = beside(model).where(distance() <= chi2_limit(REWEIGHT, P)).groupBy("gid").agg(F.count("*").alias("rows"), *_sums())
    empty = [F.lit(0).cast("long").alias(c) for c in _SUMS]
    near = near.unionByName(model.join(near, "gid", "left_anti").select("gid", F.lit(0).cast("long").alias("rows"), *empty))
    return staged(near.join(model, "gid").groupBy("gid").applyInPandas(_reweigh, f"gid string, {_MODEL}"), "estimates")


def judge(docs: DataFrame, least: int = LEAST_GROUP, share: float = OUTLIER_SHARE) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id text lang source``):

    ``doc_id``, the counts, ``base_failed`` and ``kept``; ``distance`` is the squared Mahalanobis
    distance from the group's estimate (null where no group is large enough:
    such rows are kept). Rows that pass the base rules estimate; a row whose
    distance is over the limit of the ``share`` farthest normal rows is not kept.
    """
    with small_batches(docs.sparkSession):
        rows = staged(measure(docs), "counts")
        of = groups(rows.where(~F.col("base_failed")), least)
        spread = ["doc_id", *(f"x{i}" for i in range(P))]
        cell = F.pmod(F.xxhash64(*spread), F.floor(F.col("n") / CELL_ROWS) + 1).cast("int")
        cells = spread_join(rows.where(~F.col("base_failed")), of.where("gid IS NOT NULL"), ["key"], spread).select(
            "gid", cell.alias("cell"), "n", *(f"x{i}" for i in range(P))
        )
        cells = staged(cells.repartition("gid", "cell"), "cells")
        model = of.join(estimate(cells), "gid", "left").drop("n")
        judged = spread_join(rows, model, ["key"], spread, "left").withColumn("distance", distance())
        far = F.coalesce(F.col("distance") > chi2_limit(1 - share, P), F.lit(False))
        return judged.select("doc_id", *_NAMES, "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "distance", "key")
