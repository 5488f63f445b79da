import base64
import random

import public_tokenizers as public
import pytest
import tiktoken

from stringloom.llm import bpe

PATH = public.path("byte_bpe_multi_50k.tiktoken")
TEXTS = [None, "", " ", "a", "Das ieß schön,  won't  \n\n x", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "日本語のテキスト 😀😀", "\x00\x01<|endoftext|> end", "x" * 5000, "ab" * 3001 + "é" * 2000, "word " * 3000]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_pieces_match_library(library):
    codec, rng = bpe.Codec(PATH, public.PATTERN), random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyzéñßABC' \n0123.,!日"
    for n in [*range(1, 80), 300, 2000]:
        for _ in range(12):
            text = "".join(rng.choice(letters if rng.random() < 0.8 else "aaaabth") for _ in range(n))
            assert codec.encode(text).tolist() == library.encode_ordinary(text)


def test_long_text_in_runs(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bpe, "RUN", 7)
    text = "the of and shthon éaux " * 50
    assert bpe.Codec(PATH, public.PATTERN).encode(text).tolist() == library.encode_ordinary(text)


def test_frame_round_trip(spark, library):
    rows = [(i % 3, t, "kept") for i, t in enumerate(TEXTS * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, PATH, public.PATTERN), PATH, public.PATTERN).collect()
    assert len(out) == len(rows)
    for r in out:
        assert list(r["ids"]) == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_one_pass(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in bpe.encode(df, PATH, public.PATTERN, decoded="decoded").collect():
        assert bytes(r["decoded"]) == (r["text"] or "").encode()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, PATH, public.PATTERN), PATH, public.PATTERN).collect() == []


def test_unbroken_pieces(library):
    codec, rng = bpe.Codec(PATH, public.PATTERN), random.Random(4)
    pieces = ["a" * 20_000, "ab" * 5000, "".join(rng.choice("ab") for _ in range(6000)), "".join(rng.choice("thesandi") for _ in range(6000)), "é" * 3000]
    for text in pieces:
        assert codec.encode(text).tolist() == library.encode_ordinary(text)
    for n in (65, 100, 1000):
        data = "".join(rng.choice("theinga") for _ in range(n)).encode()
        assert list(codec.merge_long(data)) == library.encode_ordinary(data.decode())  # letters only: one piece


def test_result_name_in_another_case(spark):
    df = spark.createDataFrame([(1, "a b", "x", "y")], "doc_id long, text string, IDS string, Decoded string")
    out = bpe.encode(df, PATH, public.PATTERN, decoded="decoded")
    assert out.columns == ["doc_id", "text", "ids", "decoded"] and out.select("ids", "decoded").first()["decoded"] == b"a b"
    assert bpe.decode(bpe.encode(df, PATH, public.PATTERN), PATH, public.PATTERN).select("decoded").first()[0] == b"a b"
