import io
import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest

from stringloom.llm import token_files as tf

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)  # with the library's defaults


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("width", [2, 4])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(kind, width, n):
    ids = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint32)
    assert (tf.from_planes(tf.to_planes(ids, width, kind), n, width, kind) == ids).all()


def test_chunks_equal_whole_texts(library):
    rng, e = random.Random(2), tf.Encoder(PATH)
    letters = list("abcXYZ019.,.,.,!'’\"#<>|-_éÉñß日😀") + [" ", " ", " ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "́", "̸", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "'s", "İ", "Σ", "ﬁ"]
    texts = ["", "".join(letters), *("".join(rng.choice(letters) for _ in range(n)) for n in range(1, 60) for _ in range(10))]
    lengths, ids = e.encode(texts, 2)
    want = [[*x.ids, 2] for x in library.encode_batch(texts, add_special_tokens=False)]
    assert lengths.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]


def test_special_strings_and_other_steps(library, monkeypatch):
    text = "a <|endoftext|> B<|startoftext|>c <|ENDOFTEXT|>"
    want = [*library.encode(text, add_special_tokens=False).ids, 2]
    assert 49407 in want and tf.Encoder(PATH).encode([text], 2)[1].tolist() == want
    monkeypatch.setattr(tf, "STEPS", {"normalizer": None})
    assert tf.Encoder(PATH).encode([text, None], 2)[1].tolist() == [*want, 2]


def test_ids_must_fit():
    with pytest.raises(ValueError):
        tf.to_planes(np.array([1, 1 << 16], np.uint32), 2, "byte")


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_files(spark, library, kind):
    texts = [None, "", "one two # three", "x" * 3000, 'quote " # !'] * 6
    rows = [(i * 7 % 31 if i else None, t, 0) for i, t in enumerate(texts)] + [(5, "again", 1), (5, "again", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start int")
    manifest = tf.write(df, PATH, end=2, width=2, kind=kind, block=64)
    out = sorted(tf.read(manifest).collect(), key=lambda r: r["start"])
    at = 0
    for r, (k, t, _) in zip(out, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))):
        want = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (k, at, len(want))
        assert zlib.crc32(r["ids"]) == zlib.crc32(np.array(want, "<u4").tobytes())
        at += len(want)
    assert len(out) == len(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tf.read(tf.write(df, PATH)).collect() == []
