"""Token ids: encoding with a public tokenizer, and ids as Parquet list columns.

Null texts count as empty. Rows that repeat a ``doc_id`` are all kept, in the order of
their text's digest; null ids come first. Other columns of the input are ignored,
whatever their names are. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from stationflow.session import shared_dir

from .common import gather_ranges, slices, small_batches, staged, text_key

END_ID = 0
SLICE_CHARS = 500_000
MEMO_WORDS = 400_000

# Characters whose class is the same in Python's patterns and in the tokenizer's: other texts are encoded whole.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2027\\u20ac]")
_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\u024f"
_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_PIECE = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\\s{_LETTER}{_NUMBER}]+|\\s+(?!\\S)|\\s+"
)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """Number of each piece; an unseen one gets the next and is noted as new."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class Encoder:
    """Encodes batches of texts; ids equal the tokenizer's own for the whole text.

    The tokenizer cuts a text into pieces and encodes each alone, so ids of
    pieces seen before are kept and new pieces go through the tokenizer's model. Over ``memo_words``
    pieces, those that came most often stay, half of that at the most. Texts that spell a token of the vocabulary's own,
    such as ``<|endoftext|>``, go through the tokenizer whole, as do texts with unusual characters.
    """

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.own = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.memo_words = memo_words
        self.memo = _Memo()
        self.ids = np.empty(1 << 16, dtype=np.int32)
        self.used = 0
        self.starts = np.empty(1 << 15, dtype=np.int64)
        self.lengths = np.empty(1 << 15, dtype=np.int64)
        self.seen = np.zeros(1 << 15, dtype=np.int64)

    def _forget(self) -> None:
        """Keep the pieces that came most often, twice at the least."""
        n = len(self.memo)
        often = np.argsort(-self.seen[:n], kind="stable")[: self.memo_words // 2]
        often = np.sort(often[self.seen[often] > 1])
        pieces = list(self.memo)
        self.memo = _Memo()
        self.memo.update(zip([pieces[i] for i in often.tolist()], range(len(often))))
        lengths = self.lengths[often]
        ids = self.ids[gather_ranges(self.starts[often], lengths)]
        self.used = len(ids)
        self.ids[: self.used] = ids
        self.starts[: len(often)] = np.cumsum(lengths) - lengths
        self.lengths[: len(often)] = lengths
        self.seen[:] = 0

    def _learn(self, pieces: list[str], k: int) -> None:
        """Encode new pieces, numbered from ``k`` on; none of them holds a zero byte."""
        spelt = "\x00".join(pieces).encode().decode("latin1").translate(self.letters).split(self.letters[0])
        tokenize = self.model.tokenize
        flat: list[int] = []
        ends = []
        for s in spelt:
            flat += [x.id for x in tokenize(s)]
            ends.append(len(flat))
        lengths = np.diff(np.array(ends), prepend=0)
        n, size = len(ends), len(flat)
        if self.used + size > len(self.ids):
            self.ids = np.resize(self.ids, max(self.used + size, 2 * len(self.ids)))
        if k + n > len(self.starts):
            more = max(k + n, 2 * len(self.starts))
            self.starts, self.lengths = np.resize(self.starts, more), np.resize(self.lengths, more)
            self.seen = np.concatenate([self.seen, np.zeros(more - len(self.seen), dtype=np.int64)])
        self.ids[self.used : self.used + size] = flat
        self.starts[k : k + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[k : k + n] = lengths
        self.used += size

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many pieces, and how many each has."""
        if len(self.memo) > self.memo_words:
            self._forget()
        memo = self.memo
        known = len(memo)
        at = np.fromiter(map(memo.__getitem__, pieces), dtype=np.int64, count=len(pieces))
        if memo.new:
            self._learn(memo.new, known)
            memo.new = []
        came = np.bincount(at)
        self.seen[: len(came)] += came
        lengths = self.lengths[at]
        return self.ids[gather_ranges(self.starts[at], lengths)], lengths

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the count of each text."""
        parts, counts = [], np.zeros(len(texts), dtype=np.int64)
        for lo, hi in slices([len(t) for t in texts], SLICE_CHARS):
            run: list[str] = []
            bounds = [0]
            todo = []
            for i in range(lo, hi):
                if _UNUSUAL.search(texts[i]) or any(t in texts[i] for t in self.own):
                    self._flush(run, bounds, todo, counts, parts)
                    ids = self.tokenizer.encode(texts[i], add_special_tokens=False).ids
                    counts[i] = len(ids)
                    parts.append(np.array(ids, dtype=np.int32))
                    run, bounds, todo = [], [0], []
                else:
                    run += _PIECE.findall(texts[i])
                    bounds.append(len(run))
                    todo.append(i)
            self._flush(run, bounds, todo, counts, parts)
        return (np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)), counts

    def _flush(self, run, bounds, todo, counts, parts) -> None:
        if todo:
            ids, lengths = self._pieces(run)
            ends = np.concatenate([[0], np.cumsum(lengths)])[bounds]
            counts[todo] = np.diff(ends)
            parts.append(ids)


@lru_cache(maxsize=1)
def shared_encoder(path: str) -> Encoder:
    """The encoder of a Python worker; its tasks share what it has seen."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Append the end id to each document."""
    full = counts + 1
    out = np.full(int(full.sum()), end_id, dtype=np.int32)
    keep = np.ones(len(out), dtype=bool)
    keep[np.cumsum(full) - 1] = False
    out[keep] = ids
    return out, full


def _with_ids(encoder: Encoder, batch: pa.RecordBatch, text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, pa.ListArray]]:
    """Parts of a batch with the number of ids of each row (the end id included), and the ids."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy()
    for lo, hi in slices(sizes.tolist(), SLICE_CHARS):
        part = batch.slice(lo, hi - lo)
        ids, counts = with_end(*encoder.encode([t or "" for t in part.column(text).to_pylist()]))
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        yield part, counts, pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))


def encoding(path: str, kept: Sequence[str], text: str = "text"):
    """Batches with ``ids`` (the end id included) and ``n_tokens`` beside the ``kept`` columns, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(path)
        for batch in batches:
            for part, counts, ids in _with_ids(encoder, batch, text):
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), pa.array(counts), ids], names=[*kept, "n_tokens", "ids"]
                )

    return run


def encoded(rows: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Replace the ``text`` column by ``ids`` (the end id included) and ``n_tokens``, row by row."""
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(*kept).selectExpr("*", "0L n_tokens", "array(0) ids").schema
    return rows.mapInArrow(encoding(path, kept, text), schema)


def write_token_table(
    docs: DataFrame, out: str, path: str | None = None, row_group_bytes: int = 64 << 20,
    page_bytes: int = 1 << 20, page_rows: int = 2_000,
) -> None:
    """Write documents as token ids, in ascending ``doc_id`` order.

    Files follow the order of ids, and so do rows in them: file ``shard`` 0 has
    the smallest ids. Rows without an id or of one id are dealt out by their text's digest and, where
    that is the same, by a number of the row, and are in this order. ``ids`` is a dictionary-encoded list column, the columns
    beside it (``doc_id n_tokens before shard``) are delta-encoded; page
    indexes let a reader of a few ids skip pages, and a reader of metadata
    skips the id column. ``before`` counts the ids of earlier rows in the file.
    """
    path = path or tokenizer_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # rows that are wholly alike may change places, so their numbers need not be the same in a repeated task
    order = ["doc_id", "key", "copy"]
    keyed = rows.withColumns({"key": text_key(F.col("text")), "copy": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order).drop("key", "copy")
    schema = "doc_id long, n_tokens long, before long, shard int, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, shard, before = shared_encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for part, counts, ids in _with_ids(encoder, batch, "text"):
                starts = before + np.cumsum(counts) - counts
                before += int(counts.sum())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts), pa.array(starts.astype(np.int64)),
                     pa.array(np.full(len(counts), shard, dtype=np.int32)), ids],
                    names=["doc_id", "n_tokens", "before", "shard", "ids"],
                )

    (
        ordered.mapInArrow(run, schema).write
        .option("parquet.writer.version", "v2").option("parquet.block.size", row_group_bytes)
        .option("parquet.page.size", page_bytes).option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "false").option("parquet.enable.dictionary#ids.list.element", "true")
        .parquet(out)
    )
    sums = docs.sparkSession.read.parquet(out).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = F.sum("n").over(W.orderBy("shard")) - F.col("n")  # one row for each file
    sums.select("shard", earlier.alias("earlier")).write.parquet(f"{out}-shards")


def read_token_table(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """``doc_id start n_tokens`` and the asked columns of a token table.

    ``start`` counts the ids of all documents before. Only the asked columns
    are read. What comes before each file is a small table beside it.
    """
    return spark.read.parquet(path).join(spark.read.parquet(f"{path}-shards"), "shard").select(
        "doc_id", (F.col("earlier") + F.col("before")).alias("start"), "n_tokens", *columns
    )


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by the crc32 of its ids as little-endian unsigned 32-bit integers."""
    kept = [c for c in rows.columns if c != "ids"]
    schema = rows.select(*kept).selectExpr("*", "0L ids_crc32").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            ends = lists.offsets.to_numpy().tolist()
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(sums, pa.int64())], names=[*kept, "ids_crc32"]
            )

    return rows.mapInArrow(run, schema)


def token_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Write documents as a token table in the shared folder and read each one's digest back."""
    spark = docs.sparkSession
    out = shared_dir(spark, "tokens")
    with small_batches(spark):
        write_token_table(docs, out, path)
        return staged(ids_crc32(read_token_table(spark, out)), "digests")
