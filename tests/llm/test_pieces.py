import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from waypoint.llm import pieces as p

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", "a", " a", "a ", "a  b", "   ", "\n\n a\nb c\n", "x\ty\r\nz", "▁abc d▁", "日本語 テスト é", "<s> hi </s>", "a" * 300, "    def f():\n        return 1",
    "https://host/x?q=1#frag " * 3, "🙂🙂 z", "\x00 nul", "word " * 5000, "Supercalifragilisticexpialidocious " + "x1" * 40,
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(0)
    made = ["".join(rng.choice(" abcdefghthe\nin.,éç01_ ingreonat") for _ in range(rng.randint(1, 90))) for _ in range(300)]
    return TEXTS + made


@pytest.mark.parametrize("max_rows", [p.MAX_ROWS, 200, 0])
def test_ids_are_the_librarys_and_decode_back(spark, rows, texts, max_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = rows([(k, t, "clash") for k, t in enumerate(texts)], "doc_id bigint, text string, ids string").repartition(3)
    out = p.decode(p.encode(df, MODEL, max_rows=max_rows), MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    for r in out.collect():
        t = texts[r.doc_id] or ""
        assert list(r.ids) == library.encode(t), t
        assert r.decoded == t.replace("▁", " ") if t else r.decoded == ""
    assert p.encode(df.limit(0), MODEL).count() == 0


def test_report(spark, rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = rows([(1, "some words\nof text"), (1, "some words\nof text"), (2, None), (None, "▁ mark")], "doc_id bigint, text string")
    out = sorted((tuple(r) for r in p.report(df, MODEL).collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    ids = lambda t: b"".join(k.to_bytes(4, "little") for k in library.encode(t))
    want = [(i, len(library.encode(t)), sha(ids(t)), sha(t.replace("▁", " ").encode()), "▁" not in t) for i, t in [(1, "some words\nof text")] * 2 + [(2, ""), (None, "▁ mark")]]
    assert out == sorted(want, key=str)


def test_lattice_cuts_equal_merging(spark, rows):
    own = p.load_pieces(MODEL)
    rng = random.Random(9)
    words = {"".join(rng.choice("theinorat▁sé") for _ in range(rng.randint(2, 30))) for _ in range(400)}
    words |= {"▁" + "international" * 4, "x" * 61}
    for r in p.word_cuts(rows([(w, 1) for w in words], "word string, uses bigint"), own).collect():
        if r.cuts is not None:
            assert [k for k in range(len(r.word) + 1) if r.cuts >> k & 1] == p.merge_word(r.word, own), r.word


def test_words_are_those_of_the_pattern(spark, rows, texts):
    import re
    from collections import Counter

    own = p.load_pieces(MODEL)
    odd = ["  two  spaces\n  indented line ", "\n\n x", "one\n two\nthree  four", "▁▁a ▁b\n▁c"]
    df = rows([(t,) for t in texts + odd], "text string")
    want = Counter(w for t in texts + odd if t for w in re.findall(own.word_pattern(), "▁" + t.replace(" ", "▁")) if 2 <= len(w) <= 61)
    assert {r.word: r.uses for r in p.distinct_words(df, own).collect()} == dict(want)


def test_dictionary_keeps_what_is_used_most(spark, rows):
    own = p.load_pieces(MODEL)
    df = rows([("often often often often seldom",), ("often twice twice",)], "text string")
    assert p.cut_dictionary(df, own).least == 1
    few = p.cut_dictionary(df, own, max_rows=2)
    held = p.Encoder(own, few).table.find(["▁often", "▁twice", "▁seldom"])
    assert [x is not None for x in held] == [True, True, False]
    assert p.cut_dictionary(df, own, max_rows=0) is None


def test_words_of_several_texts_are_looked_up_together(spark, rows, monkeypatch):
    own = p.load_pieces(MODEL)
    texts = ["one two\nthree", None, "two  four\nfive", "", "six one"]
    encoder = p.Encoder(own, p.cut_dictionary(rows([(t,) for t in texts], "text string"), own))
    asked = []
    find = encoder.table.find
    monkeypatch.setattr(encoder.table, "find", lambda words: asked.append(len(words)) or find(words))
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert [x.tolist() for x in encoder.encode_all(texts)] == [library.encode(t or "") for t in texts]
    assert len(asked) <= 2 and sum(asked) == len({"▁one", "▁two", "three", "▁▁four", "five", "▁six"} | {"▁two"}) + 1


def test_lattice_makes_no_substring_without_a_piece_of_its_head(spark, rows):
    own = p.load_pieces(MODEL)
    lengths = {r.head: r.lengths for r in p._lengths(rows([("x", 1)], "word string, uses bigint"), own).collect()}
    assert all(lengths[x[:3]].count(len(x)) == 1 for x in own.ranks if len(x) > 2)
    assert set(lengths) == {x[:3] for x in own.ranks if len(x) > 2}
