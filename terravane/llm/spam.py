"""Keyword-stuffed and link-list pages, by the perplexity of word-class sequences.

Texts are cut into blocks (see ``notebooks``) and each block becomes a sequence of word classes:
function words of the corpus's languages, content words by case and by how lately and how often they
came before, identifiers, numbers, links, tags, scripts, line ends and marks. Two n-gram models are
counted over the whole corpus. The prose model is taught by the blocks that are sentences: function
words (or hiragana), marks that end sentences, no links and few words that come over and over, so that a keyword that
happens to hold a function word ("filter of lens filter of lens ...") teaches nothing. The other model
is taught by what stands beside prose, on pages that are mostly prose: code, outputs, headings, lists.

A block is abnormal where its perplexity is high under both models, or where it is low under the prose
model because the same few words repeat without end. What is high or low comes from the corpus itself,
the distribution of block perplexities over its taught pages (``thresholds``). A page is reported where more than half of its text
stands in abnormal blocks.

Embedded data (base64) is no text: it counts in no block. The models' tables are bounded by the number
of classes to the power of the order, whatever the corpus.

Defined results: null, empty and blank texts, and pages whose abnormal blocks have fewer than
``least`` tokens, give no row. Rows with the same key give one row if one of them is such a page. An
empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.llm.notebooks import TEXT, parts
from terravane.llm.words import over_all_cores
from terravane.session import cut_lineage

#: Function words of English, Spanish, German and French.
FUNCTION_WORDS = """
a an the this that these those each every some any no all both and or but nor so if then than because while of to in
on at by for from with without into over under between after before during about as is are was were be been being has
have had do does did will would can could should may might must not it its he she they we you i me my our your their
his her who which what when where how why there here also only more most other such very just again still yourself
itself themselves
el la los las un una unos unas y o u e ni pero que de del al con sin por para según entre hasta desde sobre tras es son
era fue ser está están se su sus lo le les más menos muy ya si como cuando donde qué cómo esta este estos estas ese esa
eso hay ha han vamos antes mientras
der die das den dem des ein eine einer einem einen eines und oder aber nicht kein keine im am auf aus bei mit nach von
vom zu zum zur für über unter vor zwischen durch ohne um ist sind war waren wird werden hat haben kann lässt sich er
sie wir ihr man wie was wo wenn dass ob auch nur noch schon sehr mehr als bevor selbst wollen
du et ou mais ne pas plus dans sur avec sans pour par ce cet cette ces il elle nous vous ils elles sont était être ont
""".split()  # fmt: skip

CLASSES = "pad function word word_again Capital Capital_again CAPS CAPS_again often identifier number long link tag data hiragana kanji line gap . , ; : ? ( ) [ ] { quote - * | / = < > # % mark symbol".split()
V = len(CLASSES)
ID = {name: i for i, name in enumerate(CLASSES)}
DATA, LINK = "", ""
BLOB = re.compile(r"data:[\w/+.;=-]{1,80};base64,[A-Za-z0-9+/=\s\\]+")
URL = re.compile(r"http[s]?://[^\s<>\"')\]]+")
AGAIN = 20
OFTEN, OFTEN_SPAN = 3, 40

# char groups: 0 separator, 1 word, 2 hiragana, 3 kanji, 4 blank, 5 line end, 6 mark
_GROUP = np.full(0x10000, 6, dtype=np.uint8)
_MARK = np.full(0x10000, ID["symbol"], dtype=np.uint8)
_LOWER = np.arange(0x10000, dtype=np.uint64)
_UPPER = np.zeros(0x10000, dtype=bool)
_LETTER = np.zeros(0x10000, dtype=bool)
_DIGIT = np.zeros(0x10000, dtype=bool)


def _fill_tables() -> None:
    for i in range(0x10000):
        c = chr(i)
        if 0x3040 <= i <= 0x309F:
            _GROUP[i] = 2
        elif 0x30A0 <= i <= 0x30FF or 0x3400 <= i <= 0x9FFF:
            _GROUP[i] = 3
        elif c == "\n":
            _GROUP[i] = 5
        elif c.isspace():
            _GROUP[i] = 4
        elif c.isalnum() or c == "_":
            _GROUP[i] = 1
            _LETTER[i], _DIGIT[i] = c.isalpha(), c.isdigit()
            low = c.lower()
            _UPPER[i] = c != low
            _LOWER[i] = ord(low) if len(low) == 1 and ord(low) < 0x10000 else i
        elif i < 128:
            _MARK[i] = ID["mark"]
    _GROUP[0] = 0
    for marks, name in ((".…。", "."), (",、", ","), (";", ";"), (":：", ":"), ("?!¿¡？！", "?"), ("(", "("), (")", ")"), ("[", "["), ("]", "]"), ("{}", "{"), ("'\"`’‘“”«»「」", "quote"), ("-–—", "-"), ("*", "*"), ("|", "|"), ("/", "/"), ("=", "="), ("<", "<"), (">", ">"), ("#", "#"), ("%", "%"), (DATA, "data"), (LINK, "link")):
        for c in marks:
            _MARK[ord(c)] = ID[name]
    _GROUP[ord(DATA)] = _GROUP[ord(LINK)] = 6


_fill_tables()
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(int(_STEP), -1, 2**64))


_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse, kept for the next call."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, _BACK)):
            powers = np.full(n, base, dtype=np.uint64)
            powers[0] = 1
            _powers[i] = np.multiply.accumulate(powers)
    return _powers[0], _powers[1]


def _hash(words: list[str]) -> np.ndarray:
    out = []
    for word in words:
        value = 0
        for i, c in enumerate(word):
            value = (value + (int(_LOWER[ord(c)]) + 1) * pow(int(_STEP), i, 2**64)) % 2**64
        out.append(value)
    return np.unique(np.array(out, dtype=np.uint64))


_FUNCTION = _hash(FUNCTION_WORDS)


def tokenize(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all tokens, and the number of the text each belongs to.

    ``order - 1`` pad tokens stand before each text's own; their text number is -1.
    """
    pads = "\0" * (order - 1)
    points = np.frombuffer((pads + pads.join(texts)).encode("utf-32-le", "replace"), dtype=np.uint32)
    points = np.where(points < 0x10000, points, 0xFFFD)
    group = _GROUP[points]
    begins = np.ones(len(points), dtype=bool)
    begins[1:] = (group[1:] != group[:-1]) | (group[1:] == 6) | (group[1:] == 0)
    start = np.flatnonzero(begins)
    end = np.append(start[1:], len(points))
    kind = group[start]
    length = end - start
    out = np.zeros(len(start), dtype=np.uint8)
    out[kind == 2], out[kind == 3], out[kind == 5] = ID["hiragana"], ID["kanji"], ID["line"]
    wide = (kind == 4) & (length > 1)
    out[wide] = ID["gap"]
    marks = kind == 6
    out[marks] = _MARK[points[start[marks]]]
    word = np.flatnonzero(kind == 1)
    if len(word):
        s, e = start[word], end[word]

        def sums(flags: np.ndarray) -> np.ndarray:
            total = np.zeros(len(flags) + 1, dtype=np.int32)
            np.cumsum(flags, out=total[1:])
            return total[e] - total[s]

        n = e - s
        letters, digits, uppers = sums(_LETTER[points]), sums(_DIGIT[points]), sums(_UPPER[points])
        powers, back = _power_tables(len(points))
        total = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum((_LOWER[points] + np.uint64(1)) * powers[: len(points)], out=total[1:])
        code = (total[e] - total[s]) * back[s]
        at = np.minimum(np.searchsorted(_FUNCTION, code), len(_FUNCTION) - 1)
        function = _FUNCTION[at] == code
        # content words that came at most AGAIN content words before in the same text, and those that
        # came OFTEN times within OFTEN_SPAN
        plain = np.flatnonzero((letters == n) & ~function)
        text_of = np.searchsorted(np.flatnonzero(group == 0), s[plain])
        sorting = np.lexsort((plain, code[plain], text_of))
        again = np.zeros(len(plain), dtype=bool)
        rank = np.arange(len(plain))
        same = (code[plain][sorting][1:] == code[plain][sorting][:-1]) & (text_of[sorting][1:] == text_of[sorting][:-1])
        again[sorting[1:]] = same & (rank[sorting][1:] - rank[sorting][:-1] <= AGAIN)
        often = np.zeros(len(plain), dtype=bool)
        if len(plain) > OFTEN:
            a, b = sorting[OFTEN:], sorting[:-OFTEN]
            often[a] = (code[plain][a] == code[plain][b]) & (text_of[a] == text_of[b]) & (rank[a] - rank[b] <= OFTEN_SPAN)
        cls = np.full(len(word), ID["identifier"], dtype=np.uint8)
        cls[digits == n] = ID["number"]
        base = np.where(uppers[plain] == 0, ID["word"], np.where((uppers[plain] == n[plain]) & (n[plain] > 1), ID["CAPS"], ID["Capital"]))
        cls[plain] = np.where(often, ID["often"], base + again)
        cls[function] = ID["function"]
        cls[n >= 40] = ID["long"]
        hash_before = (s > 0) & (points[s - 1] == 35)
        cls[hash_before] = ID["tag"]
        out[word] = cls
        drop = word[hash_before] - 1
        out[drop] = 255
    keep = (out != 255) & ~((kind == 4) & ~wide)
    classes, place = out[keep], start[keep]
    pad = kind[keep] == 0
    owner = np.searchsorted(np.flatnonzero(group == 0)[:: order - 1], place, side="right") - 1
    owner[pad] = -1
    return classes, owner


def ngram_codes(classes: np.ndarray, order: int) -> np.ndarray:
    """Number of the n-gram that ends at each token from the one with index ``order - 1`` on."""
    n = len(classes) - order + 1
    out = np.zeros(max(n, 0), dtype=np.int32)
    for j in range(order):
        out = out * V + classes[j : j + len(out)]
    return out


SLICE = 200_000


def _slices(pieces: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of about SLICE characters, so that the arrays of a slice stay in the cache."""
    begin, size = 0, 0
    for i, piece in enumerate(pieces):
        size += len(piece)
        if size >= SLICE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(pieces):
        yield begin, len(pieces)


class Page:
    """Blocks of a batch of pages as one class sequence."""

    def __init__(self, texts: list[str | None], styles: list[str | None], order: int) -> None:
        pieces: list[str] = []
        page, size, kinds = [], [], []
        for i, (text, style) in enumerate(zip(texts, styles)):
            if not text or not text.strip():
                continue
            if "base64," in text:
                text = BLOB.sub(DATA, text)
            for kind, block in parts(text, style):
                page.append(i)
                kinds.append(kind)
                size.append(len(block))
                pieces.append(URL.sub(LINK, block) if "http" in block else block)
        pieces = [p.replace("\0", " ") for p in pieces]
        self.page, self.size = np.array(page, dtype=np.int64), np.array(size, dtype=np.int64)
        self.kind = np.array(kinds, dtype=np.int64)
        if not pieces:
            self.codes = self.owner = np.zeros(0, dtype=np.int64)
            self.tokens = self.functions = self.links = self.ends = self.often = self.words = self.size
            return
        codes, owners = [], []
        for a, b in _slices(pieces):
            classes, owner = tokenize(pieces[a:b], order)
            own = owner[order - 1 :]
            real = np.flatnonzero(own >= 0)
            codes.append(ngram_codes(classes, order)[real])
            owners.append(own[real] + a)
        self.codes, self.owner = np.concatenate(codes), np.concatenate(owners)
        tail = self.codes % V
        count = lambda *names: np.bincount(self.owner[np.isin(tail, [ID[n] for n in names])], minlength=len(pieces))
        self.tokens = np.bincount(self.owner, minlength=len(pieces))
        self.functions = np.maximum(count("function"), count("hiragana"))
        self.links = count("link", "tag")
        self.ends = count(".", "?")
        self.often = count("often")
        self.words = self.functions + self.often + count("word", "word_again", "Capital", "Capital_again", "CAPS", "CAPS_again", "kanji")

    def sentences(self) -> np.ndarray:
        """Blocks that hold sentences, with links or without."""
        return (self.kind == TEXT) & (self.tokens >= 8) & (self.functions > 0.2 * self.words) & (60 * self.ends >= self.tokens) & (self.often < 0.2 * self.tokens)

    def prose(self) -> np.ndarray:
        """Blocks that consist of sentences."""
        return self.sentences() & (self.links == 0)


    def teaching(self) -> np.ndarray:
        """Pages that are mostly sentences, by their number."""
        whole = np.bincount(self.page, weights=self.size)
        return 2 * np.bincount(self.page, weights=self.size * self.sentences(), minlength=len(whole)) > np.maximum(whole, 1)


def _small(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _count(order: int):  # noqa: ANN202
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, V**order), dtype=np.int64)
        for batch in _small(batches):
            p = Page(batch.column(1).to_pylist(), batch.column(2).to_pylist(), order)
            if not len(p.size):
                continue
            prose, used = p.prose(), p.teaching()[p.page]
            for kind, flags in ((0, prose), (1, ~prose & used)):
                codes, n = np.unique(p.codes[flags[p.owner]], return_counts=True)
                counts[kind][codes] += n
        for kind in (0, 1):
            at = np.flatnonzero(counts[kind])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind), pa.int32()), pa.array(at, pa.int64()), pa.array(counts[kind][at], pa.int64())], names=["kind", "ngram", "n"])

    return work


def log_model(counts: np.ndarray, order: int, weight: float = 20.0) -> np.ndarray:
    """Bits of each n-gram's last class after the others; each order backs off to the shorter one."""
    counts = counts.astype(np.float64).reshape((V,) * order)
    lower = counts.sum(axis=tuple(range(order - 1)))
    p = (lower + 1) / (lower.sum() + V)
    for k in range(2, order + 1):
        c = counts.sum(axis=tuple(range(order - k))) if k < order else counts
        p = (c + weight * p) / (c.sum(axis=-1, keepdims=True) + weight)
    return -np.log2(p).astype(np.float32).ravel()


def train(pages: DataFrame, order: int) -> np.ndarray:
    """Bits tables of the prose and the other model; pages has doc, text and style."""
    rows = pages.mapInArrow(_count(order), "kind int, ngram bigint, n bigint").groupBy("kind", "ngram").agg(F.sum("n").alias("n")).toArrow()
    kind, ngram, n = (rows.column(i).to_numpy() for i in range(3))
    tables = []
    for k in (0, 1):
        counts = np.zeros(V**order, dtype=np.int64)
        counts[ngram[kind == k]] = n[kind == k]
        tables.append(log_model(counts, order))
    return np.stack(tables)


#: Shares of the taught pages' tokens beyond which a block's perplexity is high, and low with its factor.
HIGH_SHARE, LOW_SHARE, LOW_FACTOR = 0.999, 0.001, 0.5
BLOCKS = "doc bigint, taught boolean, best array<float>, prose array<float>, size array<int>, tokens array<int>, sentences array<boolean>"


def measured(pages: DataFrame, order: int) -> DataFrame:
    """One row for each page with text: the bits a token, characters and tokens of its blocks, under both models."""
    model = pages.sparkSession.sparkContext.broadcast(train(pages, order))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.value
        for batch in _small(batches):
            p = Page(batch.column(1).to_pylist(), batch.column(2).to_pylist(), order)
            if not len(p.size):
                continue
            prose, other = (np.bincount(p.owner, weights=t[p.codes], minlength=len(p.size)) / np.maximum(p.tokens, 1) for t in tables)
            kept, first = np.unique(p.page, return_index=True)
            offsets = pa.array(np.append(first, len(p.page)).astype(np.int32))
            lists = [np.minimum(prose, other).astype(np.float32), prose.astype(np.float32), p.size.astype(np.int32), p.tokens.astype(np.int32), p.prose()]
            columns = [batch.column(0).take(pa.array(kept)), pa.array(p.teaching()[kept]), *[pa.ListArray.from_arrays(offsets, pa.array(x)) for x in lists]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "taught", "best", "prose", "size", "tokens", "sentences"])

    return pages.mapInArrow(work, BLOCKS)


def _quantile(rows: DataFrame, bits: str, share: float, step: float = 0.01) -> float | None:
    """The bits a token below which the share of all tokens lies, to a step; one row a step reaches the driver."""
    bins = rows.groupBy(F.floor(F.col(bits) / step).alias("bin")).agg(F.sum("tokens").alias("n")).toPandas().sort_values("bin")
    if not len(bins):
        return None
    at = int(np.searchsorted(bins.n.cumsum(), share * bins.n.sum()))
    return float(bins.bin.iloc[min(at, len(bins) - 1)] + 1) * step


def thresholds(blocks: DataFrame) -> tuple[float, float]:
    """(high, low) of the blocks' bits a token, from the distribution over the tokens of taught pages.

    High is what all but a thousandth of them stay below; low is half of what a thousandth of the tokens
    of prose stay below. Without a taught page nothing is known and nothing is abnormal.
    """
    each = blocks.where("taught").select(F.explode(F.arrays_zip("best", "prose", "tokens", "sentences")).alias("b")).select("b.*").where("tokens > 0")
    high, low = _quantile(each, "best", HIGH_SHARE), _quantile(each.where("sentences"), "prose", LOW_SHARE)
    return (np.inf if high is None else high), (0.0 if low is None else low * LOW_FACTOR)


def score(pages: DataFrame, doc: str, text: str = "text", style: str | None = None, order: int = 4, least: int = 12) -> DataFrame:
    """(doc, abnormal, share, bits) for each page with text: share of abnormal text, bits a token of it all.

    The corpus is read twice, to count the models and to measure the blocks. Of the measured blocks, some
    16 bytes each, a reliable checkpoint is kept, which gives the thresholds and then the pages.
    """
    style_column = F.col(style) if style else F.lit(None).cast("string")
    rows = pages.where(F.col(doc).isNotNull() & (F.length(text) > 0)).select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"), style_column.alias("style"))
    blocks = cut_lineage(measured(over_all_cores(rows), order))
    high, low = thresholds(blocks)

    def total(weight: str, where: str = "true") -> Column:
        each = f"transform(arrays_zip(best, prose, size, tokens), b -> if(b.tokens > 0 AND {where}, {weight}, 0D))"
        return F.expr(f"aggregate({each}, 0D, (a, b) -> a + b)")

    odd = f"(b.best > {high!r}D OR b.prose < {low!r}D)" if np.isfinite(high) else f"b.prose < {low!r}D"
    size = F.expr("aggregate(size, 0D, (a, b) -> a + b)")
    share = total("double(b.size)", odd) / F.greatest(size, F.lit(1.0))
    bits = total("b.best * double(b.tokens)") / F.greatest(total("double(b.tokens)"), F.lit(1.0))
    abnormal = (share > 0.5) & (total("double(b.tokens)", odd) >= least)
    return blocks.select(F.col("doc").alias(doc), abnormal.alias("abnormal"), share.alias("share"), bits.alias("bits"))


def spam_pages(pages: DataFrame, doc: str, text: str = "text", style: str | None = None, **settings: float) -> DataFrame:
    """(doc) of each keyword-stuffed or link-list page."""
    return score(pages, doc, text, style, **settings).where("abnormal").select(doc).distinct()
