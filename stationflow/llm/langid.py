"""Language identification by compression.

Each language has a raw-content dictionary of sample texts; a text gets the
language whose dictionary makes its zstandard frame smallest. Null texts and
texts without a letter are ``und`` with score 0. Equal sizes go to the
language first by name. Rows are judged one by one: repeated rows, null ids
and extra columns pass through; an empty table gives an empty result. Without
any labelled text every row is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

UNKNOWN = "und"
LEVEL = 3
FINE_LEVEL = 19
DICT_BYTES = 192 * 1024
DICT_DOCS = 400
DICT_TEXT_CHARS = 20_000
MARGIN = 0.0005
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = re.compile(r"[\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a text has a letter; fractions, superscripts and number signs are none."""
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def letters(text: str) -> bytes:
    """What is compressed: the whole text in lower case, what lies between letters as one space."""
    return _OTHER.sub(" ", text.lower()).encode("utf-8", "replace")


def coders(dictionaries: dict[str, bytes], level: int) -> list:
    """A compressor for each language, by name."""
    import zstandard

    out = []
    for lang in sorted(dictionaries):
        content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        content.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=content, level=level))
    return out


def learn(labelled: DataFrame, docs: int = DICT_DOCS, dict_bytes: int = DICT_BYTES) -> dict[str, bytes]:
    """Dictionaries by language, from ``lang`` and ``text``.

    At most ``docs`` different texts a language, of all lengths, are drawn by a hash of the
    text, so the layout of the data makes no difference. Of a drawn text at most
    ``DICT_TEXT_CHARS`` characters go to the driver, and ``dict_bytes`` of them all
    into the dictionary. The counts that set the drawing rate cover all rows.
    """
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & (F.length("text") > 0)
    )
    rows = rows.withColumn("h", F.xxhash64("text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language, as in the result
    rate = F.lit(0.0)
    for r in counts:
        rate = F.when(F.col("lang") == r.lang, (1 << 20) * 3.0 * docs / r.n + 1).otherwise(rate)
    few = rows.where(F.pmod("h", F.lit(1 << 20)) < rate).withColumn("text", F.left("text", F.lit(DICT_TEXT_CHARS))).dropDuplicates(["lang", "h", "text"])
    rank = F.row_number().over(W.partitionBy("lang").orderBy("h", "text"))
    found: dict[str, list[str]] = {}
    for r in few.withColumn("r", rank).where(F.col("r") <= docs).orderBy("lang", "r").select("lang", "text").collect():
        found.setdefault(r.lang, []).append(r.text)
    out = {}
    for lang, texts in found.items():
        parts, size = [], 0
        for t in dict.fromkeys(texts):
            data = letters(t) + b"\n"
            if size + len(data) <= dict_bytes:
                parts.append(data)
                size += len(data)
        out[lang] = b"".join(parts) or letters(texts[0])[:dict_bytes]
    return out


def judge(text: Column, dictionaries: dict[str, bytes], margin: float = MARGIN) -> Column:
    """``struct<lang_pred, score, rejected>`` of a text.

    Sizes that lie within 1 % or two bytes are taken again at a finer
    level. ``score`` compares the sizes (1: the others are far larger).
    ``rejected`` marks ``und``, and texts whose best two sizes then differ by at
    most ``margin`` of the size: a judgement by a byte or none.
    """
    langs = sorted(dictionaries)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fast, fine = coders(dictionaries, LEVEL), []
        for texts in batches:
            names, scores, rejects = [], [], []
            for t in texts:
                if not langs or t is None or not has_letter(t):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    rejects.append(True)
                    continue
                data = letters(t)
                sizes = np.array([len(c.compress(data)) for c in fast], dtype=float)
                if len(langs) > 1 and np.partition(sizes, 1)[1] - sizes.min() <= 2 + 0.01 * sizes.min():
                    fine = fine or coders(dictionaries, FINE_LEVEL)
                    sizes = np.array([len(c.compress(data)) for c in fine], dtype=float)
                best = int(sizes.argmin())
                over = sizes - sizes[best]
                near = np.partition(over, 1)[1] if len(over) > 1 else np.inf
                names.append(langs[best])
                scores.append(float(1 / np.exp(-over / (2 + 0.005 * sizes[best])).sum()))
                rejects.append(bool(near <= margin * sizes[best]))
            yield pd.DataFrame({"lang_pred": names, "score": scores, "rejected": rejects})

    return run(text)
