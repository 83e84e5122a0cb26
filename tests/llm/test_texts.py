import json
import os

import numpy as np
import pytest

from terravane.llm.leakage import Codes, Index, kgram_hashes, leaked, winnow
from terravane.llm.notebooks import CODE, OUTPUT, TEXT, blocks, parts
from terravane.llm.spam import Page, score, spam_pages, tokenize
from terravane.llm.tokenizer import DEFAULT_RANKS, Encoder, PrefixTable, Vocabulary, encode_corpus, read_ranks
from terravane.llm.words import unescape, words

HAVE = os.path.exists(DEFAULT_RANKS)
needs_ranks = pytest.mark.skipif(not HAVE, reason="no vocabulary file")
ITEM = "The council of Ulkalo decided that every miller older than 42 years must repaint its causeway using no more than 53 buckets of lime."


def test_words():
    assert words("It's **bold**_text_ ÉTÉ-7") == ["it", "s", "bold", "text", "été", "7"]
    assert words(unescape(json.dumps("one\ntwo \"three\" é"))) == ["one", "two", "three", "é"]
    assert unescape("a\\\\nb") == "a\\nb"


def test_winnowing_misses_no_shared_window():
    rng = np.random.default_rng(0)
    for n in range(60):
        shared = rng.integers(0, 50, 12)
        a = np.concatenate([rng.integers(100, 200, n % 17), shared, rng.integers(100, 200, 9)]).astype(np.uint64)
        b = np.concatenate([rng.integers(300, 400, 5), shared, rng.integers(300, 400, n % 13)]).astype(np.uint64)
        ha, hb = kgram_hashes(a, 6), kgram_hashes(b, 6)
        assert set(ha[winnow(ha, 7)]) & set(hb[winnow(hb, 7)])
    assert len(winnow(np.zeros(3, dtype=np.uint64), 7)) == 0 and len(kgram_hashes(np.zeros(2, dtype=np.uint64), 6)) == 0


def test_leaks(spark):
    w = ITEM.split()
    rows = [
        (1, "Intro. " + " ".join(w[:12]).upper() + " end", "percent"),
        (2, "Intro. " + " ".join(w[:11]) + " end", "percent"),
        (3, json.dumps({"cells": [{"source": ["x\n", "# " + " **".join(w[3:9]) + "\n", "# " + " ".join(w[9:20])]}]}), "json"),
        (4, None, "json"), (5, "", None), (6, "   ", None), (7, ("filler words go on " * 20_000) + ITEM, "prompt"),
        (8, "# " + "\n# ".join(" ".join(w[i : i + 4]) for i in range(0, 16, 4)), None), (8, "# " + "\n# ".join(" ".join(w[i : i + 4]) for i in range(0, 16, 4)), None),
    ]
    corpus = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id bigint, text string, nb_style string, doc string, style int")
    tests = spark.createDataFrame([(10, ITEM, "x"), (10, ITEM, "x"), (11, "short text", "x"), (12, None, "x"), (13, "", "x")], "item_id bigint, text string, item string")
    for size in (5_000_000, 10):
        got = {(r.doc_id, r.item_id): r.n_words for r in leaked(corpus, tests, "doc_id", "item_id", style="nb_style", block_words=size).collect()}
        assert got == {(1, 10): 12, (3, 10): 17, (7, 10): 24, (8, 10): 16}
    assert leaked(corpus.limit(0), tests, "doc_id", "item_id").count() == 0 and leaked(corpus, tests.limit(0), "doc_id", "item_id").count() == 0
    assert Index([], 6, 12).search(np.array([Codes()[x] for x in words(ITEM)], dtype=np.uint64)) == {}


def test_blocks_of_notebooks():
    assert blocks("# %% [markdown]\n# Hello\n# there\n\n# %%\nx = 1\n\n# Out:\n# 1\n", "percent") == ["Hello\nthere\n\n", "x = 1\n", "\n1\n"]
    assert blocks("Text\r\n\r\nIn [1]: a = 1\r\n...: b\r\n\r\nOut[1]: 2", "prompt") == ["Text", "a = 1\nb", "2"]
    whole = json.dumps({"cells": [{"cell_type": "code", "source": ["a\n", 'b "c"'], "outputs": [{"text": ["out"]}, {"data": {"text/plain": ["z"]}}]}]})
    assert blocks(whole, "json") == ['a\nb "c"', "out", "z"]
    assert [k for k, _ in parts(whole, "json")] == [CODE, OUTPUT, OUTPUT]
    assert [k for k, _ in parts("Text\n\nIn [1]: a = 1\n\nOut[1]: 2", "prompt")] == [TEXT, CODE, OUTPUT]
    assert [k for k, _ in parts("# %% [raw]\nx\n# %%\ny\n# Out:\n# 1\n", "percent")] == [TEXT, CODE, OUTPUT]
    assert blocks(whole[:-12], "json")[:2] == ['a\nb "c"', "out"]
    assert blocks("{", None) == ["{"] and blocks("", "json") == []


def test_word_classes():
    from terravane.llm.spam import CLASSES

    names = lambda t: [CLASSES[c] for c in tokenize([t], 3)[0]][2:]
    assert names("The Cat sat, SAT sat_1 42  #tag\n") == ["function", "Capital", "word", ",", "CAPS_again", "identifier", "number", "gap", "tag", "line"]
    assert names("") == [] and names("橋を") == ["kanji", "hiragana"]
    p = Page(["a b", None, " ", "c"], [None, None, None, None], 3)
    assert p.page.tolist() == [0, 3] and p.tokens.tolist() == [2, 1]


PROSE = "In this section we compare the {a} camera and check whether the {b} still agrees with the {c}. After 12 rounds the {a} stops changing, which we take as a sign that the {b} is stable."


def page(n):
    nouns = "bridge river tram survey harvest ledger roof module slope terrain".split()
    pick = lambda k: nouns[(n * 7 + k * 3) % 10]
    prose = " ".join(PROSE.format(a=pick(k), b=pick(k + 1), c=pick(k + 2)) for k in range(4))
    return f"# %% [markdown]\n# ## Load the {pick(1)}\n# {prose}\n\n# %%\nx_{n} = load('{pick(2)}.csv', sep=';')\nx_{n}.head({n})\n\n# Out:\n#     a    b\n# 0   1.5  2.5\n"


def test_spam_pages(spark):
    rows = [(n, page(n), "percent") for n in range(120)]
    rows += [
        (1000, "# %% [markdown]\n# " + " ★ ".join(["cheap lamp price", "buy lamp", "best lamp online", "lamp discount"] * 12), "percent"),
        (1001, "\n".join(f"- [cheap lamp {k}](https://shop{k}.example/p/{k})" for k in range(40)), "prompt"),
        (1002, page(5) + "\n# %% [markdown]\n# tags: lamp, roof, river\n", "percent"),
        (1003, None, "json"), (1004, "", None), (1005, "  \n ", "percent"), (1006, '{"cells": [', "json"),
        (1000, "# %% [markdown]\n# " + " ★ ".join(["cheap lamp price", "buy lamp"] * 24), "percent"),
    ]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "doc_id bigint, text string, nb_style string, doc string, share double")
    assert {r.doc_id for r in spam_pages(df, "doc_id", style="nb_style").collect()} == {1000, 1001}
    scored = score(df, "doc_id", style="nb_style").collect()
    assert len(scored) == 125 and all(0 <= r.share <= 1 and r.bits >= 0 for r in scored)
    assert spam_pages(df.limit(0), "doc_id").count() == 0


def test_keywords_with_function_words_teach_nothing(spark):
    """A phrase that holds function words makes no sentences, at any size of the corpus or share of such pages."""
    def phrases(n):
        return " ".join(("filtro de lente", "precio", "en línea", "filtro de lente", "barato")[(n + k * k) % 5] for k in range(60 + n % 7))
    p = Page(["# %% [markdown]\n# " + phrases(1), page(1)], ["percent"] * 2, 4)
    assert not p.prose()[p.page == 0].any() and p.prose()[p.page == 1].any()
    for n, m in ((120, 2), (120, 40), (480, 160)):
        rows = [(k, page(k), "percent") for k in range(n)] + [(1000 + k, "# %% [markdown]\n# " + phrases(k), "percent") for k in range(m)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, nb_style string")
        assert {r.doc_id for r in spam_pages(df, "doc_id", style="nb_style").collect()} == {1000 + k for k in range(m)}


def test_nothing_is_abnormal_without_a_taught_page(spark):
    df = spark.createDataFrame([(1, "cheap lamp cheap lamp " * 30)], "doc_id bigint, text string")
    assert spam_pages(df, "doc_id").count() == 0 and score(df, "doc_id").count() == 1


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(read_ranks(DEFAULT_RANKS))


def reference():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(DEFAULT_RANKS), special_tokens={})


@needs_ranks
def test_encoding_is_exact(vocabulary):
    import random

    random.seed(0)
    ref, alphabet = reference(), "aaab stm're'll've'd  \n\t  '’_-=1234éßДあ漢🔥　\xa0\x00<|endoftext|>"
    texts = ["".join(random.choices(alphabet, k=random.randint(0, 60))) for _ in range(400)] + ["x" * 3000, " " * 500, "=" * 700 + "ab" * 400, "don't I'll 'tis we'vexed", ""]
    encoder = Encoder(vocabulary, keep=50)
    for part in (texts[:200], texts[200:]):
        ids, offsets = encoder.encode(part)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [ref.encode_ordinary(t) for t in part]
    ids, offsets = encoder.encode([None, "", None])
    assert len(ids) == 0 and offsets.tolist() == [0, 0, 0, 0]


@needs_ranks
def test_prefix_table_appends_and_edits(vocabulary):
    import random

    random.seed(1)
    for _ in range(20):
        data = bytearray("".join(random.choices("abcdef ghijklm", k=120)).encode())
        table = PrefixTable(vocabulary, bytes(data[:40]))
        table.append(bytes(data[40:]))
        assert table.ids() == PrefixTable(vocabulary, bytes(data)).ids()
        at = random.randint(0, 100)
        new = bytes(random.choices(b"xyz ab", k=random.randint(0, 9)))
        table.replace(at, at + 7, new)
        data[at : at + 7] = new
        assert table.ids() == PrefixTable(vocabulary, bytes(data)).ids() and bytes(table.data) == bytes(data)


@needs_ranks
def test_corpus_round_trip(spark):
    rows = [(1, "Hello  world's <|endoftext|>\n", 0), (2, "", 0), (3, None, 0), (4, "漢字 " * 4000, 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, doc int")
    got = {r.doc_id: r.ids for r in encode_corpus(df, "doc_id").collect()}
    ref = reference()
    assert got[2] == [] and got[3] == [] and ref.decode(got[4]) == rows[3][1] and got[1] == ref.encode_ordinary(rows[0][1])
    assert encode_corpus(df.limit(0), "doc_id").count() == 0
