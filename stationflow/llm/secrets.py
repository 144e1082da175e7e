"""Secret scans: fixed patterns and a battery of randomness tests, with DataFrame operations only.

Null and empty texts hold no secrets. Rows that repeat a ``doc_id`` are judged
one by one. Extra columns are ignored, whatever their names are. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import staged, text_key

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
FALSE_SHARE = 0.01
# Alphabets a candidate may be written in, narrowest first: name, what it consists of, its characters in order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "234567ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64url", "^[0-9A-Za-z_-]+$", "-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz"),
    ("base64", ".", "+/0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_"),
)
# What ordinary long strings (joined words, numbers, paths) look like: excess of the squared frequencies over
# uniform ones, share of places where the kind of character changes, correlation of neighbours.
PLAIN_EXCESS = {"hex": 0.6, "HEX": 0.6, "base32": 1.2, "base62": 3.0, "base64url": 3.0, "base64": 3.0}
PLAIN_CHANGES = 0.08
PLAIN_SERIAL = {"hex": 0.4, "HEX": 0.4, "base32": 0.4, "base62": 0.8, "base64url": 0.8, "base64": 0.8}
# The three tests see the same string; their scores are added as if correlated by this much.
TEST_CORRELATION = 0.5
# Lengths judged together, and the steps a tenfold p-value is cut into.
LENGTHS = (20, 24, 32, 48, 64, 128)
P_STEPS = 20


def upper_tail(z: Column) -> Column:
    """P(N(0, 1) > z), by the usual rational approximation (error under 1e-7); never 0."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = 0.3989422804014327 * F.exp(-F.least(a * a / 2, F.lit(700.0))) * series
    return F.when(z >= 0, tail).otherwise(1 - tail)


def battery(tokens: DataFrame) -> DataFrame:
    """Add ``encoding`` and ``p`` to candidate strings in ``value``.

    ``p`` is the chance that an ordinary string of this length looks as random
    in its encoding: chi-squared uniformity of the alphabet, runs of one kind
    of character, and correlation of neighbours, added as normal scores.
    """
    name = F.lit(None).cast("string")
    letters = F.lit(None).cast("string")
    excess, serial = F.lit(None).cast("double"), F.lit(None).cast("double")
    for code, shape, alphabet in reversed(ENCODINGS):
        fits = F.col("value").rlike(shape)
        name = F.when(fits, code).otherwise(name)
        letters = F.when(fits, alphabet).otherwise(letters)
        excess = F.when(fits, PLAIN_EXCESS[code]).otherwise(excess)
        serial = F.when(fits, PLAIN_SERIAL[code]).otherwise(serial)
    df = tokens.select(
        "*", name.alias("encoding"), letters.alias("__a"), excess.alias("__x"), serial.alias("__c"),
        F.split("value", "").alias("__l"),
    )
    df = df.withColumn("__v", F.transform("__l", lambda c: F.instr(F.col("__a"), c) - 1))
    df = df.withColumns({"__n": F.size("__v").cast("double"), "__k": F.length("__a").cast("double")})
    squares = F.aggregate(
        F.array_distinct("__l"), F.lit(0.0),
        lambda s, c: s + F.pow(F.length("value") - F.length(F.replace(F.col("value"), c, F.lit(""))), F.lit(2.0)),
    )
    mean, spread = (F.col("__k") - 1) / 2, (F.col("__k") * F.col("__k") - 1) / 12
    products = F.aggregate(
        F.sequence(F.lit(1), F.size("__v") - 1), F.lit(0.0),
        lambda s, i: s + (F.get("__v", i) - mean) * (F.get("__v", i - 1) - mean),
    )
    # upper, lower or digit; the characters that join words and paths do not count
    kinds = F.translate(
        "value", "BCDEFGHIJKLMNOPQRSTUVWXYZbcdefghijklmnopqrstuvwxyz123456789+/_-", "A" * 25 + "a" * 25 + "0" * 9
    )
    df = df.withColumns({"__s": squares, "__p": products, "__t": kinds})
    df = df.withColumn("__r", F.length(F.regexp_replace("__t", r"(.)\1*", "x")))
    n, k, x = F.col("__n"), F.col("__k"), F.col("__x")
    chi = k * F.col("__s") / n - n
    uniform = -(chi - (k - 1 + n * x)) / F.sqrt(2 * (k - 1) + 4 * n * x)
    places = F.greatest(F.length("__t") - 1, F.lit(1))
    changes = (F.col("__r") - 1 - places * PLAIN_CHANGES) / F.sqrt(places * PLAIN_CHANGES * (1 - PLAIN_CHANGES))
    close = -(F.col("__p") / ((n - 1) * spread) - F.col("__c")) * F.sqrt(n - 1)
    score = (uniform + changes + close) / (3 + 6 * TEST_CORRELATION) ** 0.5
    return df.withColumn("p", upper_tail(score)).drop(*[c for c in df.columns if c.startswith("__")])


def discoveries(tested: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Candidates that pass the step-up procedure of their group of lengths.

    All p-values of a group count. They are rounded up to steps, so one small
    histogram (groups x steps) sets each group's limit.
    """
    group = F.lit(0)
    for i, n in enumerate(LENGTHS):
        group = F.when(F.length("value") >= n, i).otherwise(group)
    rows = tested.withColumns(
        {"__g": group, "__b": F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) * P_STEPS).cast("int")}
    )
    counts = rows.groupBy("__g", "__b").agg(F.count("*").alias("n"))
    least = counts.select(
        "__g", "__b",
        F.sum("n").over(W.partitionBy("__g").orderBy(F.desc("__b"))).alias("above"),
        F.sum("n").over(W.partitionBy("__g")).alias("all"),
    ).where(F.pow(F.lit(10.0), -F.col("__b") / P_STEPS) * F.col("all") <= false_share * F.col("above"))
    limits = staged(least.groupBy("__g").agg(F.min("__b").alias("least")), "limits")
    return rows.join(limits, "__g").where("__b >= least").drop("__g", "__b", "least")


def _matches(text: Column, pattern: str, value: int = 0) -> Column:
    """List of (gap before, match, group ``value``) in the order of the text."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else found
    return F.transform(
        F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), found.alias("m"), groups.alias("v")),
        lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["m"]).alias("n"), x["v"].alias("value")),
    )


def find(docs: DataFrame, false_share: float = FALSE_SHARE) -> DataFrame:
    """Spans of secrets: ``doc_id key kind start end``, each once; code points, ``end`` exclusive.

    ``kind`` counts from 0 as in ``KINDS``; ``key`` is the digest of the text.
    Matches of a text carry only lengths and leave it at once; their places
    are sums over the matches before, within one text.
    """
    rows = docs.select("doc_id", text_key(F.col("text")).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    parts = []
    for kind, (pattern, value) in enumerate(((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (CANDIDATE, 0))):
        parts.append(F.when(F.col("t").rlike(pattern), _matches(F.col("t"), pattern, value)).alias(f"k{kind}"))
    lists = rows.select("doc_id", "key", *parts).where("k0 IS NOT NULL OR k1 IS NOT NULL OR k2 IS NOT NULL OR k3 IS NOT NULL")
    lists = staged(lists, "matches")
    each = None
    for kind in range(4):
        own = lists.select("doc_id", "key", F.lit(kind).alias("kind"), F.posexplode(f"k{kind}").alias("i", "m"))
        each = own if each is None else each.union(own)
    each = (
        each.select("doc_id", "key", "kind", "i", "m.gap", "m.n", "m.value").repartition("doc_id", "key", "kind")
        .dropDuplicates(["doc_id", "key", "kind", "i"])
    )
    so_far = W.partitionBy("doc_id", "key", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    spans = each.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far)).select(
        "doc_id", "key", "kind", (F.col("end") - F.col("n")).alias("start"), "end", "value"
    )
    spans = staged(spans, "spans")
    base = spans.where("kind IN (1, 2) OR kind = 0 AND length(value) >= 8").drop("value")
    random = discoveries(battery(spans.where("kind = 3")), false_share)
    return base.unionByName(random.select(*base.columns))


def by_document(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: counts, and digests and lists of its spans."""
    listed = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))

    def shown(s: Column) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    found = listed.select(
        "doc_id", "key", "s", F.filter("s", lambda x: x["kind"] < 3).alias("base"),
        *[F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)],
    ).select("*", shown(F.col("base")).alias("b"), shown(F.col("s")).alias("spans"))
    rows = docs.select(F.col("doc_id"), text_key(F.col("text")).alias("key"))
    return rows.alias("d").join(
        found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.key") == F.col("f.key")), "left"
    ).select(
        "d.doc_id", *[F.coalesce(f"n_{k}", F.lit(0).cast("long")).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(F.coalesce("b", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"),
        F.coalesce("n_random", F.lit(0).cast("long")).alias("n_random"),
    )


def redact(docs: DataFrame, spans: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Replace each secret by ``mark``; all columns and rows of ``docs`` stay, ``n_chars`` follows the text."""
    listed = spans.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__s"))
    listed = listed.select(F.col("doc_id").alias("__d"), F.col("key").alias("__k"), "__s")
    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    cut = F.aggregate(
        "__s", start,
        lambda acc, x: F.when(x["end"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(
                acc["out"],
                F.when(x["start"] >= acc["at"], F.concat(
                    F.col("text").substr((acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)
                )).otherwise(F.lit("")),
            ).alias("out"),
            x["end"].alias("at"),
        )),
        lambda acc: F.concat(acc["out"], F.col("text").substr((acc["at"] + 1).cast("int"), F.length("text"))),
    )
    joined = docs.join(listed, F.col("doc_id").eqNullSafe(F.col("__d")) & (text_key(F.col("text")) == F.col("__k")), "left")
    new = F.when(F.col("__s").isNotNull(), cut).otherwise(F.col("text"))
    out = joined.withColumn("text", new)
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("__s").isNotNull(), n).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
