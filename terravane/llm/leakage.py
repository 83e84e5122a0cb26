"""Evaluation texts inside training texts, by winnowing.

Texts become words (see ``words``). Of the hashes of all ``k``-grams of words the smallest of each
window of ``span - k + 1`` is a fingerprint. Two texts that share ``span`` words in a row share a whole
window and so its fingerprint, wherever the passage stands: no passage of that length is missed. Each
shared fingerprint is then extended to both sides over the words themselves, and the pair is reported
where the shared span reaches ``span`` words.

The held-out side is the stated query set. It is measured first and cut into blocks of at most
``block_words`` words by a hash of the item's key; each block is sent to the executors and all corpus
rows are scanned against it. So the size that is broadcast is bounded, no pair is shuffled before it
is proven, and a common phrase in a third of the corpus makes no skew. Up to one block of items, which
is the usual case, that is one scan of the corpus without any exchange but the last.

Defined results: null or empty texts and texts shorter than ``span`` words on either side give no
rows. Keys that come in several rows, repeated or not, give a row for each pair once, with its longest
span. Empty tables give no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.words import is_json, over_all_cores, words

BASE = np.uint64(0x9E3779B97F4A7C15)


class Codes(dict):
    """Word to 64-bit code; forgets all where it has grown to a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = code = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return code


def kgram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k word codes."""
    n = len(codes) - k + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(k):
        out = out * BASE + codes[j : j + len(out)]
    out ^= out >> np.uint64(29)
    return out * BASE


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Positions of the smallest hash of each window, the last of equal ones."""
    if len(hashes) < window:
        return np.zeros(0, dtype=np.int64)
    least = window - 1 - sliding_window_view(hashes, window)[:, ::-1].argmin(axis=1)
    return np.unique(least + np.arange(len(least)))


def shared_span(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """Start in ``a`` and length of the longest run equal in a and b that holds a[i] and b[j]."""
    back = min(i, j)
    differ = np.flatnonzero(a[i - back : i][::-1] != b[j - back : j][::-1])
    back = int(differ[0]) if len(differ) else back
    on = min(len(a) - i, len(b) - j)
    differ = np.flatnonzero(a[i : i + on] != b[j : j + on])
    return i - back, back + (int(differ[0]) if len(differ) else on)


class Index:
    """Fingerprints and words of a block of held-out texts."""

    def __init__(self, items: list[tuple[int, str]], k: int, span: int) -> None:
        self.k, self.span, self.keys, self.codes = k, span, [], []
        table, hashes, owners, places = Codes(), [], [], []
        for key, text in items:
            codes = np.array([table[w] for w in words(text)], dtype=np.uint64)
            if len(codes) < span:
                continue
            grams = kgram_hashes(codes, k)
            at = winnow(grams, span - k + 1)
            hashes.append(grams[at])
            owners.append(np.full(len(at), len(self.keys)))
            places.append(at)
            self.keys.append(key)
            self.codes.append(codes)
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, dtype=np.uint64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes = self.hashes[order]
        self.owners = np.concatenate(owners)[order] if owners else order
        self.places = np.concatenate(places)[order] if places else order

    def search(self, codes: np.ndarray) -> dict[int, tuple[int, int]]:
        """Held-out key to (start, length) of the longest shared span of at least ``span`` words."""
        grams = kgram_hashes(codes, self.k)
        at = winnow(grams, self.span - self.k + 1)
        low, high = np.searchsorted(self.hashes, grams[at], "left"), np.searchsorted(self.hashes, grams[at], "right")
        best: dict[int, tuple[int, int]] = {}
        for n in np.flatnonzero(high > low):
            for m in range(low[n], high[n]):
                owner = int(self.owners[m])
                start, length = shared_span(codes, int(at[n]), self.codes[owner], int(self.places[m]))
                key = self.keys[owner]
                if length >= self.span and length > best.get(key, (0, 0))[1]:
                    best[key] = (start, length)
        return best


def leaked(corpus: DataFrame, held_out: DataFrame, doc: str, item: str, text: str = "text", style: str | None = None, span: int = 12, k: int = 6, block_words: int = 5_000_000) -> DataFrame:
    """(doc, item, n_words, at_word) for each document that holds ``span`` words in a row of an item.

    ``style`` names the corpus column that says "json" of texts with JSON escapes; without it, or where
    it is null, a text that begins with a brace counts as such.
    """
    spark = corpus.sparkSession
    items = held_out.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(text).alias("text")).distinct()
    # runs of letters and digits, as in ``words``; splitting at blanks would not bound texts without any
    total = items.agg(F.sum(F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_words))
    style_column = F.col(style) if style else F.lit(None).cast("string")
    rows = corpus.where(F.col(doc).isNotNull() & (F.length(text) > 0)).select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), style_column.alias("style"))
    rows = over_all_cores(rows)
    out = None
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == n).collect()
        index = spark.sparkContext.broadcast(Index([(r["item"], r["text"]) for r in block], k, span))
        found = rows.mapInArrow(_scan(index), "doc bigint, item bigint, n_words int, at_word int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy("doc", "item").agg(F.max("n_words").alias("n_words"), F.max_by("at_word", "n_words").alias("at_word")).select(F.col("doc").alias(doc), F.col("item").alias(item), "n_words", "at_word")


def _scan(index):  # noqa: ANN001, ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Codes()
        known = index.value
        for batch in batches:
            docs, items, lengths, places = [], [], [], []
            if known.keys:
                for key, text, style in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    codes = np.fromiter((table[w] for w in words(text, is_json(text, style))), dtype=np.uint64)
                    if len(codes) < known.span:
                        continue
                    for item, (start, length) in known.search(codes).items():
                        docs.append(key)
                        items.append(item)
                        lengths.append(length)
                        places.append(start)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(items, pa.int64()), pa.array(lengths, pa.int32()), pa.array(places, pa.int32())], names=["doc", "item", "n_words", "at_word"])

    return work
