import hashlib
import random

import pyarrow as pa
import pytest

from stringloom.llm import chat

TEXTS = ["</s>[INST] ok [/INST]", "", None, "a", "<\\/s> <\\\\/s> \\n \\", "<s>user\nx</s>\n", "<<SYS>><</SYS>>", "é日\n😀", "[INST][\\INST]", "<|im_start|>", "x" * 300]


def test_escape_round_trip():
    rng = random.Random(1)
    bits = [*chat.CONTROLS, "<", "\\", "/s>", "s>", "[", "INST]", "|im_end|>", "é", "\n", "n"]
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    shown = chat.escape(pa.array(texts)).to_pylist()
    assert [chat.unescape(x) for x in shown] == texts
    assert not any(c in x for x in shown for c in chat.CONTROLS)
    roles = chat.escape_role(pa.array(texts)).to_pylist()
    assert [chat.unescape_role(x) for x in roles] == texts and not any("\n" in x for x in roles)


@pytest.mark.parametrize("piece", [1, 200, 4 << 20])
def test_conversations(spark, piece):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a\nb</s>", "assistant"]), rng.choice(TEXTS)) for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant", f"turn {t}") for t in range(400)] + [(51, 0, "user", "x")] * 3
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = {r["conv_id"]: r for r in chat.digest_chats(chat.format_chats(df, piece_bytes=piece)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted([(t, r or "", x or "") for k, t, r, x in rows if k == c], key=lambda x: (x[0], x[1], x[2]))
        ours = sorted(own, key=lambda x: x[0])
        whole = "".join(f"{r}\n{x}\n" for _, r, x in ours)
        loss = "".join(x for _, r, x in ours if r == "assistant")
        g = got.pop(c)
        assert g["n_turns"] == len(own)
        assert g["turns_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert not got
    if piece == 200:
        assert chat.format_chats(df, piece_bytes=piece).where("conv_id = 50").count() > 5


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digest_chats(chat.format_chats(df)).collect() == []
