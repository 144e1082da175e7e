"""Near-duplicate join of documents by the Jaccard similarity of word shingles (chosen path).

Texts that are null or have no word are similar to nothing. Rows that repeat a
``doc_id`` are documents of their own, rows repeated whole too. Texts of equal
shingle sets are one class, and similar to each other. Extra columns are
ignored, whatever their names are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import small_batches, text_key, written
from .components import components
from .shingles import mix, shingle_sets

THRESHOLD = 0.8
TARGET_RECALL = 0.9999
FIRST_LEVELS = 2
MOST_LEVELS = 6
DEEP_RATE = 3.0
DENSE = 0.25
SMALL = 1_000
MERGED = 64
SPREAD_CELLS = 1 << 18


def runs_needed(threshold: float = THRESHOLD, target: float = TARGET_RECALL, levels: int = FIRST_LEVELS) -> int:
    """Runs after which a pair at the threshold has met with the target probability.

    At each level both sets share on average one sampled token, so a pair
    survives a level with 1 - exp(-s), s being its chance in the levels below.
    Pairs over the threshold meet more often.
    """
    s = 1.0
    for _ in range(levels):
        s = 1 - math.exp(-s)
    return math.ceil(math.log(1 - target) / math.log(1 - s))


def children(tokens: np.ndarray, paths: np.ndarray, rate: float) -> np.ndarray:
    """Paths that go on from ``paths``: one for each token sampled there.

    A token is sampled where its hash under the path is below ``rate`` / (size of
    the set), so that two sets sample a shared token together.
    """
    least = np.uint64(min(float(1 << 64) - 4096, rate / len(tokens) * float(1 << 64)))
    step = max(1, SPREAD_CELLS // len(tokens))
    out = []
    for i in range(0, len(paths), step):
        some = paths[i : i + step]
        p, t = np.nonzero(mix(tokens[None, :] ^ mix(some)[:, None]) <= least)
        out.append(mix(some[p] * np.uint64(0x9E3779B97F4A7C15) + tokens[t]))
    return np.concatenate(out) if out else paths[:0]


def first_paths(tokens: np.ndarray, runs: int, threshold: float, levels: int = FIRST_LEVELS) -> np.ndarray:
    """Paths of the first levels of all runs; they depend on the set alone."""
    paths = mix(np.arange(1, runs + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for _ in range(levels):
        paths = children(tokens, paths, 1 / threshold)
    return np.unique(paths)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _digest(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = _signed(np.concatenate(values)) if values else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def _features(runs: int, threshold: float):
    """Set digest, size and first paths of each text; empty sets have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids, sizes, paths = [], [], []
            with np.errstate(over="ignore"):
                for s in shingle_sets(batch.column("text").to_pylist()):
                    cids.append(_digest(s) if len(s) else None)
                    sizes.append(len(s))
                    paths.append(first_paths(s, runs, threshold) if len(s) else s)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), _lists(paths)],
                names=["doc_id", "key", "cid", "n", "paths"],
            )

    return run


def _with_sets(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (``cid``, ``rep`` and more) with the sets of its classes, from the text of one document each.

    Rows that repeat this document whole come once from each task.
    """
    kept = [c for c in wanted.columns if c != "rep"]
    schema = wanted.select(*kept).selectExpr("*", "array(0L) tokens").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            first = [c not in seen and not seen.add(c) for c in batch.column("cid").to_pylist()]
            batch = batch.filter(pa.array(first, pa.bool_()))
            sets = list(shingle_sets(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _lists(sets)], names=[*kept, "tokens"])

    same = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("key") == F.col("rep.key"))
    return rows.join(wanted, same).select(*kept, "text").mapInArrow(run, schema)


def _go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Children of large buckets, for one document a row."""
    for batch in batches:
        cids, parents, found = [], [], []
        with np.errstate(over="ignore"):
            for cid, tokens, paths in zip(*(batch.column(c) for c in ("cid", "tokens", "paths"))):
                own = tokens.values.to_numpy().view(np.uint64)
                for path in paths.as_py():
                    new = children(own, np.array([path], dtype=np.int64).view(np.uint64), DEEP_RATE / THRESHOLD)
                    cids.append(np.full(len(new), cid.as_py()))
                    parents.append(np.full(len(new), path))
                    found.append(_signed(new))
        if found:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c), pa.int64()) for c in (cids, parents, found)], names=["cid", "parent", "bucket"]
            )


def similar_pairs(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs i < j of sets at the threshold or over it, by exact counts.

    Shared tokens make up the columns of a 0/1 matrix, multiplied by its
    transpose some columns at a time.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    ranked = tokens[order]
    first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    number = np.cumsum(first) - 1
    shared = np.bincount(number)[number] > 1
    rows = np.repeat(np.arange(m), sizes)[order][shared]
    column = np.cumsum(first[shared]) - 1 if shared.any() else rows
    common = np.zeros((m, m), dtype=np.float32)
    width = max(64, (1 << 21) // m)
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for a, b in zip(edges, edges[1:]):
        if a < b:
            part = np.zeros((m, width), dtype=np.float32)
            part[rows[a:b], column[a:b] % width] = 1
            common += part @ part.T
    enough = common * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    return np.nonzero(np.triu(enough, 1))


def _least_linked(m: int, i: np.ndarray, j: np.ndarray, cids: np.ndarray) -> np.ndarray:
    """Smallest id among all that each is connected with."""
    low = cids.copy()
    while True:
        new = low.copy()
        np.minimum.at(new, i, low[j])
        np.minimum.at(new, j, low[i])
        if (new == low).all():
            return low
        low = new


def _met_before(earlier: list[list[int]], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each pair, whether its members share one of their ``earlier`` groups."""
    sizes = [len(e) for e in earlier]
    if not sum(sizes):
        return np.zeros(len(i), dtype=bool)
    member = np.repeat(np.arange(len(earlier)), sizes)
    _, column, often = np.unique(np.array([x for e in earlier for x in e], dtype=np.int64), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    member, column = member[shared], np.unique(column[shared], return_inverse=True)[1]
    met = np.zeros((len(earlier), len(earlier)), dtype=np.float32)
    for lo in range(0, int(column.max(initial=-1)) + 1, 2048):
        here = (column >= lo) & (column < lo + 2048)
        part = np.zeros((len(earlier), 2048), dtype=np.float32)
        part[member[here], column[here] - lo] = 1
        met += part @ part.T
    return met[i, j] > 0


def _compare(threshold: float):
    """Compares the members of each group, one group at a time; a link counts in the first group that both share."""

    def one(group: list[tuple]) -> Iterator[tuple]:
        members = {r[0]: r for r in group}  # a class may come twice
        if len(members) < 2:
            return
        rows = [members[c] for c in sorted(members)]
        g = group[0][4]
        i, j = similar_pairs([r[2] for r in rows], threshold)
        if not len(i):
            return
        cids = np.array([r[0] for r in rows])
        low = _least_linked(len(rows), i, j, cids)
        weights = np.array([r[1] for r in rows], dtype=np.int64)
        fresh = ~_met_before([[x for x in r[3] if x < g] for r in rows], i, j)
        links = np.zeros(len(rows), dtype=np.int64)
        np.add.at(links, i[fresh], weights[j[fresh]])
        np.add.at(links, j[fresh], weights[i[fresh]])
        for k in np.unique(np.concatenate([i, j])).tolist():
            yield int(cids[k]), int(links[k]), int(low[k])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        for batch in batches:
            out: list[tuple] = []
            tokens, groups = batch.column("tokens"), batch.column("groups")
            for k, (g, cid, weight) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("g", "cid", "weight")))):
                if group and group[0][4] != g:
                    out += one(group)
                    group = []
                if group and group[-1][0] == cid:  # the same class from another task
                    continue
                group.append((cid, weight, tokens[k].values.to_numpy().view(np.uint64).copy(), groups[k].as_py(), g))
            if out:
                yield _links(out)
        out = list(one(group)) if group else []
        if out:
            yield _links(out)

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["cid", "links", "low"])


def _sized(rows: DataFrame) -> DataFrame:
    """Members of buckets that two classes share at least, with the bucket's size."""
    counts = rows.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return rows.join(counts, "bucket")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each row of ``docs`` (``doc_id``, ``text``):

    ``doc_id class_id text_class n_links key root``. ``class_id`` is the smallest id
    among all documents connected by similar pairs, ``text_class`` the smallest
    with the same shingles (null for texts without words), ``n_links`` the number of other documents at the
    threshold, ``key`` the digest of the text, ``root`` the group of connected documents, also
    where ids are null or shared (null for texts without words).

    Chosen path: in each run a set goes to a bucket for every token that it
    samples, and on to smaller ones for the tokens sampled there; similar
    sets sample together. The first two levels need no other set and are made
    while the text is read. Buckets that one class has alone end; up to
    ``SMALL`` they are compared by brute force; larger ones are split on, at most to
    ``MOST_LEVELS``. A bucket that passes over ``DENSE`` of itself to one of its parts
    holds sets that are alike and splits no further: it is compared in pairs of
    blocks, as is what is large at the last level. Runs
    are repeated so often that a pair at the threshold meets with ``target_recall``.
    Pairs stay inside the task that compares them; each counts in one group only.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, threshold, target_recall)


def _near_duplicates(docs: DataFrame, threshold: float, target_recall: float) -> DataFrame:
    runs = runs_needed(threshold, target_recall)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")
    )
    features = written(
        rows, "features", _features(runs, threshold), "doc_id long, key long, cid long, n long, paths array<long>"
    )
    one = features.where("cid IS NOT NULL").groupBy("cid").agg(
        F.count("*").alias("weight"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "key")).alias("rep"), F.first("paths").alias("paths")
    )
    classes = written(one, "classes")
    level = written(_sized(classes.select("cid", F.explode("paths").alias("bucket"))), "level")
    level = level.select("cid", "bucket", "size")
    leaves, depth = level.where(F.col("size") <= SMALL), FIRST_LEVELS
    big, dense = level.where(F.col("size") > SMALL), []
    sets = None
    while depth < MOST_LEVELS and not big.isEmpty():
        if sets is None:
            # written, so that Spark knows whether the texts must be dealt out to meet them
            members = written(classes.join(big.select("cid").distinct(), "cid", "left_semi").select("cid", "rep"), "large")
            sets = written(_with_sets(rows, members).dropDuplicates(["cid"]), "sets")
        todo = big.groupBy("cid").agg(F.collect_set("bucket").alias("paths"))
        split = written(sets.join(todo, "cid"), f"level{depth}", _go_on, "cid long, parent long, bucket long")
        counts = split.groupBy("parent", "bucket").agg(F.count("*").alias("size")).where("size > 1")
        of = big.groupBy(F.col("bucket").alias("parent")).agg(F.max("size").alias("whole"))
        largest = counts.groupBy("parent").agg(F.max("size").alias("size")).join(of, "parent")
        alike = written(largest.where(F.col("size") > DENSE * F.col("whole")).select("parent"), f"dense{depth}")
        dense.append(big.join(alike.withColumnRenamed("parent", "bucket"), "bucket", "left_semi"))
        counts = written(counts.join(alike, "parent", "left_anti"), f"counts{depth}")
        level = split.join(counts, ["parent", "bucket"]).select("cid", "bucket", "size")
        leaves = leaves.unionByName(level.where(F.col("size") <= SMALL))
        big = written(level.where(F.col("size") > SMALL), f"big{depth}")
        depth += 1
    for part in dense:
        big = big.unionByName(part.select(*big.columns))

    # groups to compare in: small buckets join that of their smallest member, so a set is sent there once
    few = leaves.where(F.col("size") <= MERGED).select("cid", F.min("cid").over(W.partitionBy("bucket")).alias("g"))
    middle = leaves.where(F.col("size") > MERGED).select("cid", F.xxhash64("bucket", F.lit("bucket")).alias("g"))
    blocks = F.ceil(F.col("size") / SMALL).cast("int")
    own = F.pmod(F.xxhash64("cid", "bucket"), blocks).cast("int")
    cut = big.select("cid", "bucket", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other")).select(
        "cid", F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("g")
    )
    groups = few.union(middle).union(cut).groupBy("cid").agg(F.collect_set("g").alias("groups"))
    members = written(classes.select("cid", "rep", "weight").join(groups, "cid"), "members")
    sent = _with_sets(rows, members).select(F.explode("groups").alias("g"), "cid", "weight", "tokens", "groups")
    links = written(
        sent.repartition("g").sortWithinPartitions("g", "cid"), "links", _compare(threshold), "cid long, links long, low long"
    )
    roots = components(links.select(F.col("cid").alias("u"), F.col("low").alias("v")))
    known = (
        classes.select("cid", "weight", "first_id")
        .join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
        .join(roots.select(F.col("node").alias("cid"), "root"), "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    known = written(known, "known")
    ids = known.groupBy("root").agg(F.min("first_id").alias("class_id"))
    known = known.join(ids, "root").select(
        "cid", "root", "class_id", F.col("first_id").alias("text_class"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    return features.select("doc_id", "key", "cid").join(known, "cid", "left").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), "text_class",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "key", "root",
    )


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT p.a, p.b, p.c = x.n AND p.c = y.n AS same FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE 9 * p.c >= 4 * (x.n + y.n)
), r AS (
  SELECT doc_id AS node, doc_id AS other FROM d
  UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other
), c AS (SELECT node, min(other) AS class_id FROM r GROUP BY node),
l AS (SELECT a, count(*) AS n_links, min(b) FILTER (WHERE same) AS twin FROM e GROUP BY a)
SELECT d.doc_id, c.class_id, CASE WHEN len(d.w) > 0 THEN least(d.doc_id, l.twin) END AS text_class, coalesce(l.n_links, 0) AS n_links
FROM d JOIN c ON c.node = d.doc_id LEFT JOIN l ON l.a = d.doc_id
"""
