import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from stringloom.llm import align, queries

public = pytest.importorskip("public_tokenizers")


def brute(rows):
    """Plain version of the contract: tokens by the libraries, cuts by sets of offsets."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel  # noqa: F401

    a = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public.path("piece_bpe_32k.model"))
    alphabet = align._byte_alphabet()

    def tokens(text):
        x = a.encode(" " + text, add_special_tokens=False).ids
        y = b.encode(text)
        xs = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
        whole = (" " + text).encode()
        return (x, y, xs, ys) if b"".join(xs) == whole == b"".join(ys) else ([], [], [], [])

    docs, held = [], Counter()
    for doc, text in rows:
        x, y, xs, ys = tokens(text) if text else ([], [], [], [])
        ends = [{sum(map(len, zs[: i + 1])) for i in range(len(zs))} for zs in (xs, ys)]
        cuts, groups, i, j, p, q = ends[0] & ends[1], [], 0, 0, 0, 0
        for cut in sorted(cuts):
            ga, gb = [], []
            while p < cut:
                p, i = p + len(xs[i]), i + 1
                ga.append(x[i - 1])
            while q < cut:
                q, j = q + len(ys[j]), j + 1
                gb.append(y[j - 1])
            groups.append((ga, gb))
        pairs = Counter((m, n) for ga, gb in groups for m in ga for n in gb)
        held.update(pairs.keys())
        said = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        docs.append((doc, len(x), len(y), len(groups), pairs, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    best = defaultdict(int)
    for (m, _), n in held.items():
        best[m] = max(best[m], n)
    return [(d, na, nb, ng, sum(ps.values()), sum(k for p, k in ps.items() if held[p] == best[p[0]]), sum(k * held[p] for p, k in ps.items()), sha) for d, na, nb, ng, ps, sha in docs]


def corpus():
    rng = random.Random(4)
    words = ["the", "The", "naïve", "Straße", "日本語", "x=1;", "<|endoftext|>", "</s>", "<s>", "12345", "  ", "\n\n", "\t", "don't", " ", "é", "😀", "aaaaaaaaaaaaaaaaaaaaaaaa", " ", "ﬁ", "_foo_bar", "<0x41>", "!", ""]
    rows = [(i, " ".join(rng.choice(words) + rng.choice(["", ",", "s"]) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    rows += [(None, "the end"), (None, None), (90, ""), (91, " "), (92, "a▁b"), (93, "\x00 a \x00b"), (94, "q" * 5000 + " the"), (95, "日" * 3000), (3, rows[3][1]), (3, rows[3][1]), (96, " leading"), (97, "trailing "), (98, "xyzzy" * 900 + " " + "0123456789abcdef" * 300)]
    return rows


def test_query_matches_brute_force(spark, tmp_path, monkeypatch):
    rows = corpus()
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, N_A int").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    want = sorted(brute(rows), key=repr)
    for common in (align.COMMON, 40):
        monkeypatch.setattr(align, "COMMON", common)
        got = queries.op12_token_alignment(spark, str(tmp_path))
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_clashing_columns_and_empty_table(spark):
    paths = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([("own", 7, "a b", 1, 2)], "row string, doc_id long, text string, Pairs int, N_A int")
    got = align.digest(docs, *paths).collect()
    assert (got[0]["row"], got[0]["doc_id"], got[0]["n_a"], got[0]["n_best"]) == ("own", 7, 2, 2) and len(got[0]) == 9
    assert align.digest(spark.createDataFrame([], "doc_id long, text string"), *paths).collect() == []


def test_shared_cuts_are_all_found():
    rng = np.random.default_rng(1)
    for n, m, top in [(0, 5, 9), (5, 0, 9), (1, 1, 2), (50, 60, 90), (500, 40, 3000), (3000, 3000, 3500), (2000, 2000, 900000)]:
        a, b = (np.sort(rng.choice(max(top, k), k, replace=False)) for k in (n, m))
        i, j = align.shared_cuts(a, b)
        assert (a[i] == b[j]).all() and a[i].tolist() == np.intersect1d(a, b).tolist()


def test_chunks_are_exact(monkeypatch):
    monkeypatch.setattr(align, "REMEMBERED", 40)
    pair = align.Pair(public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model"))
    assert pair.chunked
    texts = [t or "" for _, t in corpus()]
    for some in (texts[:30], texts[20:60], texts[50:], texts):
        (a, n_a), (b, n_b) = pair.encode(some)
        for t, x, y in zip(some, np.split(a, np.cumsum(n_a)[:-1]), np.split(b, np.cumsum(n_b)[:-1]), strict=True):
            if len(x):
                assert x.tolist() == pair.a.encode(" " + t, add_special_tokens=False).ids and y.tolist() == pair.b.encode(t)
        assert (n_a > 0).sum() > 0.8 * len(some)
