import hashlib
import random

import numpy as np
import pytest
from starlode.llm import chat_format, embedding_dedup


def test_turns_read_back():
    rng = random.Random(1)
    parts = ["a", ":", "\\", "#", "###", "</turn>", "\n", "<", " "]
    for _ in range(3000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 8))) for _ in range(2))
        out, start, stop = chat_format.render(role, text)
        assert [t[:2] for t in chat_format.parse(out * 2)] == [(role, text)] * 2 and chat_format.unescape(out[start:stop]) == text
    with pytest.raises(ValueError):
        chat_format.parse("### user: x")


def test_events_fold(spark):
    log = [
        (1, 0, 0, 0, "open", "user", "hi"), (1, 1, 0, 0, "open", "assistant", ""), (1, 1, 0, 2, "delta", None, "lo"), (1, 1, 0, 1, "delta", None, "hel"),
        (1, 2, 0, 0, "open", "user", "x"), (1, 2, 0, 1, "edit", None, "y"), (1, 3, 0, 0, "open", "assistant", "bad"), (1, 3, 0, 1, "regenerate", None, ""),
        (1, 3, 0, 2, "delta", None, "good"), (1, 4, 0, 0, "open", "user", "z"), (1, 4, 0, 1, "delete", None, None), (None, 0, 0, 0, "open", None, None),
    ]
    df = spark.createDataFrame(log, chat_format.EVENT).selectExpr("*", "1 AS size")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat_format.fold(df).collect()}
    assert got == {(1, 0): ("user", "hi"), (1, 1): ("assistant", "hello"), (1, 2): ("user", "y"), (1, 3): ("assistant", "good"), (None, 0): ("", "")}
    with pytest.raises(Exception, match="unknown event"):
        chat_format.fold(spark.createDataFrame([(1, 0, 0, 0, "what", "a", "b")], chat_format.EVENT)).count()
    assert chat_format.read_back(chat_format.format_log(df.where("false"))).count() == 0


def test_conversations_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a\\b", chat_format.HARD, "long " * 500])) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(3, 0, "user", "tie"), (3, 0, "user", "tie"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_log(chat_format.events_of(df))).collect()}
    for c in {r[0] for r in rows}:
        own = sorted(((t, r is not None, r or "", x is not None, x or "") for cc, t, r, x in rows if cc == c))
        said, lost = "".join(f"{r}\n{x}\n" for _, _, r, _, x in own), "".join(x for _, _, r, _, x in own if r == "assistant")
        assert (got[c]["n_turns"], got[c]["turns_sha256"], got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(own), hashlib.sha256(said.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 32))
    x[50:120] = x[0] + 0.05 * rng.standard_normal((70, 32))
    x[120:150] = x[1] + 0.22 * rng.standard_normal((30, 32))
    x[150:160] = x[2]
    rows = [(i, [float(np.float32(c)) for c in v], int(i % 2) if i < 40 else 1) for i, v in enumerate(x)]
    rows += [(900, None, 1), (901, [0.0] * 32, 1), (902, [float("nan")] * 32, 1), (903, rows[0][1], None), (904, [], 1), (905, [1.0, None], 1), (906, [1.0] * 31, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n", "2 AS rep")
    got = {r["vec_id"]: r for r in embedding_dedup.dedup(spark, df, embedding_dedup.Settings(block=16)).collect()}
    v = np.array([r[1] for r in rows[:300]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:300]])
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    assert len(got) == 307 and all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in range(900, 907))
    mine = np.array([got[i]["n_links"] for i in range(300)])
    assert (mine <= link.sum(1)).all() and mine.sum() >= 0.97 * link.sum()
    assert all(got[i]["component_id"] == 50 for i in range(51, 120)) or got[51]["component_id"] == got[119]["component_id"]
    assert embedding_dedup.dedup(spark, df.where("false")).count() == 0
