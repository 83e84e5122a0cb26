"""Encoding of texts by a byte-level pair vocabulary, through prefix dynamic programming.

For each prefix of a byte string there is exactly one token that can end its encoding: the one token
that is a suffix of the prefix and is compatible with the last token of what stands before it. Two
neighbours are compatible where the merges, taken back one by one from both, never meet a pair that
would have been merged earlier. So the last tokens of all prefixes are found from left to right, and
the encoding is read backwards from the end. The stored last tokens make appends exact (go on from the
end) and edits local (go on from the first changed byte until the last tokens agree again), see
``PrefixTable``.

The corpus is encoded in batches of code points. The pre-split of the vocabulary (contractions, letter,
number and mark runs with one space before them, white space) is done with class runs in NumPy. Each
distinct piece is encoded once for each worker by the vectorised programme over all new pieces of a
batch; the worker's table of pieces is looked up by hash and then compared character by character, so
a collision cannot change a result. No special token is ever produced, their names are plain text.

Defined results: null and empty texts get an empty list. Each row of the corpus gives one row, rows
that repeat another in key and text one together. An empty table gives no rows; other columns are not
read, whatever their names.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.words import over_all_cores

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NEVER = np.int64(1 << 40)
STEP, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
LONG = 48


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids of a rank file: base64 text and rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


def _merge_of(token: bytes, ranks: dict[bytes, int]) -> tuple[int, int]:
    """The two tokens whose merge makes ``token``."""
    parts = [bytes([b]) for b in token]
    own = ranks[token]
    while len(parts) > 2:
        best, at = own, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], own)
            if rank < best:
                best, at = rank, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (ranks[parts[0]], ranks[parts[1]]) if len(parts) == 2 else (own, own)


SEEN_BITS = 22  # of the tables that say which hashes need to be looked up at all


def _pair_slot(keys: np.ndarray) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(MIX)) >> np.uint64(64 - SEEN_BITS)


class Vocabulary:
    """Tables of a byte-pair vocabulary whose ids are in merge order."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        size = max(ranks.values()) + 1
        self.ranks = ranks
        self.left, self.right = np.arange(size, dtype=np.int64), np.arange(size, dtype=np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                a, b = _merge_of(token, ranks)
                self.left[rank], self.right[rank] = a, b
                if a != rank:
                    self.pairs.setdefault((a, b), rank)
        keys = np.array([a * (1 << 20) + b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.pair_ids = np.append(np.array(list(self.pairs.values()), dtype=np.int64)[order], NEVER)
        # a token that its own bytes do not encode to can never be used; such a one has no two parts
        self.usable = {t: r for t, r in ranks.items() if len(t) == 1 or self.left[r] != r}
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        for length in sorted({len(t) for t in self.usable}, reverse=True):
            tokens = [(t, r) for t, r in self.usable.items() if len(t) == length]
            hashes = np.array([_hash_bytes(t) for t, _ in tokens], dtype=np.uint64)
            at = np.argsort(hashes)
            self.by_length.append((length, hashes[at], np.array([r for _, r in tokens], dtype=np.int64)[at]))
        self.seen = np.zeros(1 << SEEN_BITS, dtype=bool)
        for _, hashes, _ in self.by_length:
            self.seen[hashes >> np.uint64(64 - SEEN_BITS)] = True
        self.met = np.zeros(1 << SEEN_BITS, dtype=bool)
        self.met[_pair_slot(self.pair_keys)] = True
        self.longest = max(len(t) for t in self.usable)
        self.valid: dict[tuple[int, int], bool] = {}
        self.suffixes: dict[int, object] = {}
        for token, rank in self.usable.items():
            node = self.suffixes
            for b in reversed(token):
                node = node.setdefault(b, {})
            node[-1] = rank

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of tokens stays apart when its bytes are encoded together."""
        out = np.ones(len(first), dtype=bool)
        alive = np.arange(len(first))
        a, b = first.copy(), second.copy()
        limit = np.full(len(first), NEVER)
        while len(alive):
            keys = a * (1 << 20) + b
            merged = np.full(len(keys), NEVER)
            likely = np.flatnonzero(self.met[_pair_slot(keys)])
            at = np.searchsorted(self.pair_keys, keys[likely])
            merged[likely] = np.where(self.pair_keys[at] == keys[likely], self.pair_ids[at], NEVER)
            bad = merged < limit
            out[alive[bad]] = False
            go = ~bad
            a, b, limit, alive = a[go], b[go], limit[go], alive[go]
            right, left = self.right[a], self.left[b]
            a_base, b_base = right == a, left == b
            take_a = ((a > b) & ~a_base) | b_base
            done = a_base & b_base
            limit = np.where(take_a, a, b + 1)
            a, b = np.where(take_a, right, a), np.where(take_a, b, left)
            a, b, limit, alive = a[~done], b[~done], limit[~done], alive[~done]
        return out

    def pair_ok(self, a: int, b: int) -> bool:
        if (found := self.valid.get((a, b))) is None:
            if len(self.valid) > 500_000:
                self.valid.clear()
            self.valid[a, b] = found = bool(self.compatible(np.array([a], dtype=np.int64), np.array([b], dtype=np.int64))[0])
        return found


def _hash_bytes(token: bytes) -> int:
    value, power = 0, 1
    for b in token:
        value = (value + (b + 1) * power) % 2**64
        power = power * STEP % 2**64
    return value


class PrefixTable:
    """The last token of each prefix of a byte string, for appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, bytearray(), []
        self.length: list[int] = []
        self.append(data)

    def _next(self, i: int) -> tuple[int, int]:
        """Last token of the prefix of i bytes, and its length."""
        node, found = self.vocabulary.suffixes, []
        for j in range(i - 1, max(-1, i - 1 - self.vocabulary.longest), -1):
            if (node := node.get(self.data[j])) is None:
                break
            if -1 in node:
                found.append((node[-1], i - j))
        for token, length in reversed(found):
            if length == i or self.vocabulary.pair_ok(self.last[i - length - 1], token):
                return token, length
        raise AssertionError("every prefix has a last token")

    def append(self, data: bytes) -> None:
        self.data += data
        for i in range(len(self.last) + 1, len(self.data) + 1):
            token, length = self._next(i)
            self.last.append(token)
            self.length.append(length)

    def replace(self, at: int, end: int, data: bytes) -> int:
        """Puts ``data`` for the bytes at..end; gives the number of prefixes that had to be redone.

        What stands behind the edit is redone until the last tokens repeat the old ones over as many
        bytes as the longest token has: from there on nothing can differ.
        """
        old_last, old_length, rest = self.last[end:], self.length[end:], bytes(self.data[end:])
        del self.data[at:], self.last[at:], self.length[at:]
        self.append(data)
        same = 0
        for n in range(len(rest)):
            self.data.append(rest[n])
            token, length = self._next(len(self.data))
            self.last.append(token)
            self.length.append(length)
            same = same + 1 if token == old_last[n] and length <= n + 1 else 0
            if same >= self.vocabulary.longest:
                self.data += rest[n + 1 :]
                self.last += old_last[n + 1 :]
                self.length += old_length[n + 1 :]
                return len(data) + n + 1
        return len(data) + len(rest)

    def ids(self) -> list[int]:
        out, i = [], len(self.last)
        while i:
            out.append(self.last[i - 1])
            i -= self.length[i - 1]
        return out[::-1]


_powers = np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of STEP and of its inverse."""
    global _powers
    if len(_powers[0]) < n:
        out = []
        for base in (STEP, pow(STEP, -1, 2**64)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers = out[0], out[1]
    return _powers


def _candidates(vocabulary: Vocabulary, data: np.ndarray, behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens that end at each byte: place of their last byte, length and id, longest first.

    ``behind`` is the number of bytes of the piece up to and with each byte.
    """
    forward, back = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * forward[: len(data)], out=total[1:])
    places, sizes, tokens = [], [], []
    for size, hashes, ids in vocabulary.by_length:
        end = np.flatnonzero(behind >= size)
        if not len(end):
            continue
        start = end + 1 - size
        key = (total[end + 1] - total[start]) * back[start]
        likely = np.flatnonzero(vocabulary.seen[key >> np.uint64(64 - SEEN_BITS)])
        end, key = end[likely], key[likely]
        at = np.minimum(np.searchsorted(hashes, key), len(hashes) - 1)
        hit = hashes[at] == key
        places.append(end[hit])
        sizes.append(np.full(int(hit.sum()), size))
        tokens.append(ids[at[hit]])
    return np.concatenate(places), np.concatenate(sizes), np.concatenate(tokens)


def _last_tokens(vocabulary: Vocabulary, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Last token of each prefix of each piece, and its length, at the prefix's last byte."""
    behind = np.arange(len(data)) - np.repeat(begin, length) + 1
    place, size, token = _candidates(vocabulary, data, behind)
    order = np.lexsort((-size, place, behind[place]))
    place, size, token = place[order], size[order], token[order]
    group = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    rank = np.arange(len(place)) - np.repeat(group, np.diff(np.append(group, len(place))))
    # by prefix length, then by rank of the candidate
    level = behind[place]
    order = np.lexsort((rank, level))
    place, size, token, rank, level = place[order], size[order], token[order], rank[order], level[order]
    key = level * (1 << 20) + rank
    cuts = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    last = np.full(len(data), -1, dtype=np.int64)
    taken = np.zeros(len(data), dtype=np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        where, long, ids = place[a:b], size[a:b], token[a:b]
        if rank[a]:
            undecided = last[where] < 0
            where, long, ids = where[undecided], long[undecided], ids[undecided]
            if not len(where):
                continue
        inner = np.flatnonzero(long < level[a])
        if len(inner):
            fits = np.ones(len(where), dtype=bool)
            fits[inner] = vocabulary.compatible(last[where[inner] - long[inner]], ids[inner])
            where, long, ids = where[fits], long[fits], ids[fits]
        last[where], taken[where] = ids, long
    return last, taken


def encode_pieces(vocabulary: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """Encoding of each piece; the prefix programme over all short ones at once."""
    out: list[list[int]] = [[]] * len(pieces)
    short = []
    for n, piece in enumerate(pieces):
        if (rank := vocabulary.usable.get(piece)) is not None:
            out[n] = [rank]
        elif len(piece) > LONG:
            out[n] = PrefixTable(vocabulary, piece).ids()
        elif piece:
            short.append(n)
    if not short:
        return out
    short.sort(key=lambda n: -len(pieces[n]))
    length = np.array([len(pieces[n]) for n in short])
    begin = np.concatenate([[0], np.cumsum(length)])[:-1]
    data = np.frombuffer(b"".join(pieces[n] for n in short), dtype=np.uint8)
    last, taken = _last_tokens(vocabulary, data, begin, length)
    last_list, taken_list = last.tolist(), taken.tolist()
    for n, a, size in zip(short, begin.tolist(), length.tolist()):
        ids, i = [], a + size
        while i > a:
            ids.append(last_list[i - 1])
            i -= taken_list[i - 1]
        out[n] = ids[::-1]
    return out


SEPARATOR, LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3, 4
#: White space of the pre-split.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))[0]
        if kind == "L":
            table[i] = LETTER
        elif kind == "N":
            table[i] = NUMBER
    table[WHITE] = BLANK
    return table


def split_points(points: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Starts of the pieces of texts; ``stops`` are the places of separators, which are pieces too."""
    group = _classes()[points]
    group[stops] = SEPARATOR
    n = len(points)
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = group[1:] != group[:-1]
    start[stops] = True  # empty texts leave separators side by side
    runs = np.flatnonzero(start[:n])
    ends = np.append(runs[1:], n)
    blank = group[runs] == BLANK
    a, b = runs[blank], ends[blank]
    follows = np.zeros(len(b), dtype=bool)
    inside = b < n
    follows[inside] = group[b[inside]] != SEPARATOR
    split = b[follows & (b - a >= 2)]
    start[split - 1] = True
    joined = b[follows]
    start[joined[points[joined - 1] == 32]] = False
    # contractions: a lone apostrophe that begins a piece, with one of the endings behind it
    quote = np.flatnonzero((points == 39) & (group == OTHER) & start[:n])
    quote = quote[quote + 1 < n]
    quote = quote[group[quote + 1] == LETTER]
    if len(quote):
        one = points[quote + 1]
        two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        size = np.where(short, 1, np.where(long, 2, 0))
        quote, size = quote[size > 0], size[size > 0]
        start[quote + 1] = False
        after = quote + 1 + size
        inner = after < n
        after = after[inner]
        start[after[group[after] == LETTER]] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """A worker's encoder with its table of known pieces."""

    def __init__(self, vocabulary: Vocabulary, keep: int = 400_000) -> None:
        self.vocabulary, self.keep = vocabulary, keep
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.entry = np.zeros(0, dtype=np.int64)
        self.ids, self.id_at = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        self.points, self.point_at = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def _learn(self, points: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> None:
        fresh, first = np.unique(key, return_index=True)
        at = np.minimum(np.searchsorted(self.keys, fresh), max(len(self.keys) - 1, 0))
        new = np.ones(len(fresh), dtype=bool) if not len(self.keys) else self.keys[at] != fresh
        fresh, first = fresh[new], first[new]
        if not len(fresh):
            return
        words = [points[a:b].tobytes().decode("utf-32-le") for a, b in zip(start[first].tolist(), end[first].tolist())]
        encoded = encode_pieces(self.vocabulary, [w.encode() for w in words])
        count = np.array([len(x) for x in encoded], dtype=np.int64)
        size = end[first] - start[first]
        base = len(self.id_at) - 1
        self.ids = np.concatenate([self.ids, np.fromiter((i for x in encoded for i in x), dtype=np.int32, count=int(count.sum()))])
        self.id_at = np.concatenate([self.id_at, self.id_at[-1] + np.cumsum(count)])
        self.points = np.concatenate([self.points, points[_ranges(start[first], size)]])
        self.point_at = np.concatenate([self.point_at, self.point_at[-1] + np.cumsum(size)])
        keys, entry = np.concatenate([self.keys, fresh]), np.concatenate([self.entry, base + np.arange(len(fresh))])
        order = np.argsort(keys, kind="stable")
        self.keys, self.entry = keys[order], entry[order]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts in a row, and the offsets of the texts in them."""
        raw = "\0".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass")
        points = np.frombuffer(raw, dtype=np.uint32)
        stops = np.cumsum(np.array([len(t or "") + 1 for t in texts], dtype=np.int64)) - 1
        start = split_points(points, stops)
        end = np.append(start[1:], len(points))
        forward, back = powers(len(points) + 1)
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((points + np.uint64(1)) * forward[: len(points)], out=total[1:])
        size = end - start
        key = (total[end] - total[start]) * back[start]
        key ^= size.astype(np.uint64) * np.uint64(MIX)
        real = np.ones(len(start), dtype=bool)
        real[np.searchsorted(start, stops)] = False
        place = np.flatnonzero(real)
        start, end, size, key = start[place], end[place], size[place], key[place]
        if len(self.entry) > self.keep:
            self._forget()
        if not len(start):
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int32)
        self._learn(points, start, end, key)
        entry = self.entry[np.searchsorted(self.keys, key)]
        count = self.id_at[entry + 1] - self.id_at[entry]
        known = self.point_at[entry + 1] - self.point_at[entry]
        ids = self.ids[_ranges(self.id_at[entry], count)]
        # the hash only proposes an entry: every piece is held against it
        wrong = known != size
        same = ~wrong
        owner = np.repeat(np.flatnonzero(same), size[same])
        differs = points[_ranges(start[same], size[same])] != self.points[_ranges(self.point_at[entry[same]], size[same])]
        wrong[owner[differs]] = True
        if wrong.any():
            parts = np.split(ids, np.cumsum(count)[:-1])
            for n in np.flatnonzero(wrong):
                word = points[start[n] : end[n]].tobytes().decode("utf-32-le")
                parts[n] = np.array(encode_pieces(self.vocabulary, [word.encode()])[0], dtype=np.int32)
                count[n] = len(parts[n])
            ids = np.concatenate(parts)
        ends = np.concatenate([[0], np.cumsum(count)])
        offsets = np.concatenate([[0], ends[np.searchsorted(start, stops)]])
        return ids, offsets.astype(np.int32)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges begin..begin+size, in a row."""
    ends = np.cumsum(size)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)


SLICE = 400_000


def encode_corpus(corpus: DataFrame, doc: str, text: str = "text", ranks: str = DEFAULT_RANKS) -> DataFrame:
    """(doc, ids) for each row of the corpus; ``ranks`` is the path of the vocabulary on the driver."""
    vocabulary = corpus.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    rows = over_all_cores(corpus.select(F.col(doc).alias("doc"), F.col(text).alias("text")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(vocabulary))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            begin = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= SLICE or i + 1 == len(texts):
                    ids, offsets = encoder.encode(texts[begin : i + 1])
                    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, i + 1 - begin), lists], names=["doc", "ids"])
                    begin, size = i + 1, 0

    kind = dict(rows.dtypes)["doc"]
    return rows.mapInArrow(work, f"doc {kind}, ids array<int>").withColumnRenamed("doc", doc)


_loaded: dict[int, Vocabulary] = {}


def _vocabulary(ranks) -> Vocabulary:  # noqa: ANN001
    """The vocabulary's tables, once for each worker."""
    key = ranks._jbroadcast.id() if getattr(ranks, "_jbroadcast", None) else id(ranks)  # noqa: SLF001
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(ranks.value)
    return _loaded[key]
