"""Ids and texts against the library whose model file is compiled."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from webcairn.llm import sentence_pieces as S
from webcairn.llm.common import table

PATH = public_tokenizers.path(S.MODEL)
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return S.Pieces(open(PATH, "rb").read())


def texts(seed, n):
    rnd = random.Random(seed)
    kinds = [
        " \n\t",
        "ab aaa bbb the and ing tion ",
        "abcdefghijklmnopqrstuvwxyz ABC .,!?'\"-",
        "0123456789 .%",
        "▁ ▁a",
        "áéñü 日本語𝔘ß​́",
        "\x00\x01\x7f �￿",
        " " * 9 + "a",
        "=-_*#/<>s",
    ]
    for _ in range(n):
        pool = rnd.choice(kinds) + rnd.choice(kinds)
        yield "".join(rnd.choice(pool) for _ in range(rnd.randrange(0, 60)))


def test_encode_and_decode_equal_the_library(library, model):
    held = [*texts(1, 4000), "", "<s>", "</s> <unk>", "<0x0A>", " " * 100 + "x", "a" * 500, "▁" * 33]
    for text, ids in zip(held, model.encode(held)):
        want = library.encode(text, add_bos=True, add_eos=True)
        assert ids.tolist() == want, text
        assert model.decode(ids) == library.decode(want), text


def test_long_part_without_spaces(library, model):
    rnd = random.Random(2)
    text = "".join(rnd.choice(["日", "本", "the", "ing", "x", "\n", "9", "aaaa"]) for _ in range(60_000))
    assert model.encode([text])[0].tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_decode_of_any_ids(library, model):
    rnd = random.Random(3)
    size = library.get_piece_size()
    for _ in range(3000):
        ids = [rnd.choice([1, 2, 0, rnd.randrange(3, 259), rnd.randrange(size), 28705]) for _ in range(rnd.randrange(0, 9))]
        assert model.decode(np.array(ids, np.uint32)) == library.decode(ids), ids


def test_plain_merging(library, model):
    for text in texts(4, 500):
        text = text.replace(" ", S.SPACE)
        assert model.merged(text) == model.tokens(text)


def test_pair_test_equals_plain_merging(model):
    rnd = random.Random(5)
    pieces = [p for p in model.ids if model._whole(p)]
    short = [p for p in pieces if len(p) < 4]
    for _ in range(60_000):
        left, right = rnd.choice(rnd.choice([pieces, short])), rnd.choice(rnd.choice([pieces, short]))
        if left[-1] == S.SPACE or right[0] != S.SPACE:
            assert model.compatible(left, right) == (model.merged(left + right) == [left, right]), (left, right)


def test_rows(spark, documents, library):
    df, rows = documents
    df = df.selectExpr("*", "1 as ids", "2 as __n", "'x' as n_tokens")
    got = S.decode(S.encode(df, PATH), PATH).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "lang", "source", "n_chars", "__n", "n_tokens", "ids", "text"}
    want = sorted((r[0] or -1, library.encode(r[1] or "", add_bos=True, add_eos=True)) for r in rows)
    held = sorted((r.doc_id or -1, np.frombuffer(r.ids, "<u4").tolist()) for r in got)
    assert held == want
    assert sorted(r.text for r in got) == sorted(library.decode(w[1]) for w in want)


def test_query(spark, library):
    got = {r.doc_id: r for r in S.op12_sentence_pieces(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for doc_id, text in docs:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert S.decode(S.encode(df, PATH), PATH).count() == 0
