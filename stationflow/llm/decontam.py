"""Benchmark decontamination by winnowing, with DataFrame operations only.

Words are runs of letters, digits and characters from U+0080 on, A-Z in lower
case. Null and empty texts have no words, are never hit and hit nothing.
Rows that repeat a ``doc_id`` are judged one by one, repeated items count once by
id (an item without one hits words, but is none of the items counted). Extra columns are ignored, whatever their
names are. Empty tables give an empty result, or documents without hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import WORD, ascii_lower, staged, text_key

WINDOW = 10
GRAM = 5
_LOW = (1 << 32) - 1


def words(text: Column) -> Column:
    """The words of a text, an empty list for null."""
    gap = WORD.replace("[^", "[")
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), gap), "")


def _keys(hashes: Column, n: int) -> Column:
    """For each position: the hash of the ``n`` words from there (32 bits), then the position.

    The last ``n`` - 1 entries cover fewer words and must not be used.
    """
    return F.transform(
        hashes,
        lambda h, i: F.shiftleft(F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, n)]), 32).bitwiseOR(
            i.cast("long")
        ),
    )


def _least(values: Column, step: int) -> Column:
    """For each position, the lesser of its value and the one ``step`` further."""
    return F.transform(values, lambda x, i: F.least(x, F.get(values, i + step)))


def fingerprints(words_: str, window: int, gram: int) -> list[tuple[str, Column]]:
    """Steps (name, column) that lead to ``marks``: the least key in each window, each once.

    ``window`` consecutive words have ``window - gram + 1`` grams, of which the
    one with the least hash is kept, so two texts that share a window share
    a fingerprint. A mark holds the hash above and the position below.
    """
    span = window - gram + 1
    steps = [
        ("__h", F.transform(F.col(words_), lambda w: F.xxhash64(w))),
        ("__k", _keys(F.col("__h"), gram)),
    ]
    name, wide = "__k", 1
    while wide < span:  # least of 2, 4, ... neighbours, then of the whole span
        step = min(wide, span - wide)
        steps.append((f"__m{wide}", _least(F.col(name), step)))
        name, wide = f"__m{wide}", wide + step
    last = F.size(words_) - (window - 1)
    steps.append(("marks", F.array_distinct(F.slice(F.col(name), F.lit(1), F.greatest(last, F.lit(0))))))
    return steps


def _with(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    for name, column in steps:
        df = df.withColumn(name, column)
    return df


def _marks(df: DataFrame, window: int) -> DataFrame:
    """Add ``marks`` for windows of this many words."""
    gram = min(GRAM, window)
    return _with(df, fingerprints("w", window, gram))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """What of the benchmark occurs in each document.

    ``items`` (``item_id``, ``text``) has windows of ``window`` consecutive words; a
    shorter item is one window. Gives for each row of ``docs`` (``doc_id``,
    ``text``): ``doc_id n_words n_hit n_items items_sha256 contaminated`` and ``key``,
    the digest of its text.

    Fingerprints of both sides meet by hash; Spark sends the items' side
    out whole only if the size of its written table is small. Where a fingerprint
    fits, the windows around it are spelt out and compared as texts, so
    hits are exact. Lengths of short items (at most ``window`` - 1 different
    ones) are looked up, and documents get one more set of fingerprints for each.
    """
    spark = docs.sparkSession
    tests = items.select(
        F.col("item_id").cast("string").alias("item_id"), words(F.col("text").cast("string")).alias("w")
    ).where("size(w) > 0").withColumn("m", F.least(F.size("w"), F.lit(window)))
    tests = staged(tests, "items")
    lengths = sorted(r.m for r in tests.select("m").distinct().collect())
    spelt = F.transform(
        F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda s: F.array_join(F.slice("w", s, F.col("m")), " ")
    )
    windows = staged(tests.select("item_id", "m", F.explode(F.array_distinct(spelt)).alias("span")).distinct(), "windows")

    base = docs.select(
        F.col("doc_id"), text_key(F.col("text")).alias("key"), words(F.col("text").cast("string")).alias("w")
    ).select("doc_id", "key", F.size("w").cast("long").alias("n_words"), "w")
    if not lengths:
        return base.select(
            "doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
            F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), "key",
        )
    marked = [
        _marks(base, m).select("doc_id", "key", "n_words", F.lit(m).alias("m"), "marks") for m in lengths
    ]
    index = marked[0]
    for more in marked[1:]:
        index = index.union(more)
    index = staged(index, "fingerprints")
    prints = None
    for m in lengths:
        own = _marks(tests.where(F.col("m") == m), m).select("m", "marks")
        prints = own if prints is None else prints.union(own)
    prints = staged(prints, "marks").select("m", F.explode("marks").alias("f"))
    prints = staged(prints.select("m", F.shiftright("f", 32).alias("f")).distinct(), "prints")
    hits = (
        index.select("doc_id", "key", "m", F.explode("marks").alias("mark"))
        .select("doc_id", "key", "m", F.shiftright("mark", 32).alias("f"), F.col("mark").bitwiseAND(_LOW).alias("at"))
        .join(prints, ["m", "f"], "left_semi")
        .groupBy("doc_id", "key", "m").agg(F.collect_set("at").alias("at"))
    )
    hits = staged(hits, "hits")
    # the windows that hold a hit fingerprint, as texts
    around = F.transform(
        F.col("at"),
        lambda p: F.sequence(
            F.greatest(p - (F.col("m") - F.least(F.lit(GRAM), F.col("m"))), F.lit(0)),
            F.least(p, F.size("w") - F.col("m")),
        ),
    )
    texts = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text"))
    found = (
        texts.alias("b")
        .join(hits.alias("h"), F.col("b.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("b.key") == F.col("h.key")))
        .select("b.doc_id", "b.key", "m", "at", words(F.col("b.text")).alias("w"))
        .select("doc_id", "key", "m", "w", F.array_distinct(F.flatten(around)).alias("starts"))
        .select(
            "doc_id", "key", "m",
            F.explode(F.transform(
                "starts", lambda s: F.struct(s.alias("s"), F.array_join(F.slice("w", (s + 1).cast("int"), F.col("m")), " ").alias("span"))
            )).alias("x"),
        ).select("doc_id", "key", "m", "x.s", "x.span").distinct()
    )
    spans = windows.select("m", "span").distinct()
    found = staged(found.join(spans, ["m", "span"], "left_semi"), "found")
    step = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("s", (F.col("s") + F.col("m")).alias("e")))), step,
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0).cast("long"), x["e"] - F.greatest(acc["to"], x["s"]))).alias("n"),
            F.greatest(acc["to"], x["e"]).alias("to"),
        ),
    )["n"]
    hit_words = found.groupBy("doc_id", "key").agg(covered.alias("n_hit"))
    hit_items = (
        found.select("doc_id", "key", "m", "span").distinct().join(windows.where("item_id IS NOT NULL"), ["m", "span"])
        .select("doc_id", "key", "item_id").distinct()
        .groupBy("doc_id", "key").agg(F.array_sort(F.collect_list("item_id")).alias("ids"))
        .select("doc_id", "key", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    )
    result = staged(hit_words.alias("a").join(
        hit_items.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.key") == F.col("b.key")), "left"
    ).select("a.*", "n_items", "items_sha256"), "result")
    rows = index.where(F.col("m") == lengths[0]).select("doc_id", "key", "n_words").alias("d")
    return rows.join(
        result.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.key") == F.col("r.key")), "left"
    ).select(
        "d.doc_id", "d.n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"), "d.key",
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, w, least(len(w), 10) AS m FROM (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[s : s + m - 1], ' ') AS span
  FROM (SELECT item_id, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM b)
), dw AS (
  SELECT doc_id, m, s, array_to_string(w[s : s + m - 1], ' ') AS span
  FROM (SELECT doc_id, m, w, unnest(range(1, len(w) - m + 2)) AS s FROM d, (SELECT DISTINCT m FROM bw))
), hit AS (
  SELECT dw.doc_id, dw.s, dw.m, bw.item_id FROM dw JOIN bw USING (m, span)
), n AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + m)) AS p FROM hit) GROUP BY doc_id
), i AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN i USING (doc_id)
"""
