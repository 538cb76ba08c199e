"""Tokens, chat, mixing and neighbours: exact round trips and brute force."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tallyreef.llm import ann, chat, mixing, queries, tokens

from .helpers import ODD, docs, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_encoder_is_the_library():
    rng = random.Random(1)
    parts = ["a", "B", "é", "'s", "'", "'re", "'ll", "'t", "'l", " ", "  ", "\n", "\t", "1", "٣", "!", " ", "　", "中", "😀", "'d", "r", "e", "<|endoftext|>", "\x1c", "\r\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", prose(3, 5000)]
    encode = tokens.Encoder(PATH, keep=500)
    for at in range(0, len(texts), 700):
        for text, got in zip(texts[at : at + 700], encode(texts[at : at + 700]), strict=True):
            assert got.tolist() == encode.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", range(9))
def test_packing_round_trip(n):
    values = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7], dtype=np.uint32)[:n]
    assert tokens.unpack(*tokens.pack(values), n).tolist() == values.tolist()


def test_shards_round_trip(spark):
    rows = [r[:2] for r in ODD if r[0] is not None and r[0] != 7] + [(k, prose(k, 40)) for k in range(50, 90)]
    library = tokens.Encoder(PATH).tokenizer
    want, start = [], 0
    for doc, text in sorted(rows):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for block in (1_000_000, 50):
        blocks, ranks = tokens.write_shards(docs(spark, rows, extra=True), PATH, block_ids=block)
        assert sorted(map(tuple, tokens.read_shards(blocks, ranks).collect())) == want
    odd = tokens.token_shards(docs(spark, ODD), PATH).collect()
    assert len(odd) == len(ODD) and sum(r["doc_id"] is None for r in odd) == 1
    assert tokens.token_shards(docs(spark, []), PATH).count() == 0


def test_chat_round_trip_of_any_text():
    rng = random.Random(2)
    parts = [*chat.CONTROL, " ", "\\", "a", "\n", "é", ""]
    for _ in range(4000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "<<ROLE:", ">> \\"]), "".join(rng.choice(parts) for _ in range(rng.randrange(6)))) for _ in range(rng.randrange(1, 5))]
        text = "".join(chat.render_turn(*t)[0] for t in turns)
        assert [(role, said) for role, said, _, _ in chat.parse(text)] == turns
    assert chat.parse("<s>[INST] open") is None and chat.parse("") == []


def test_chat_digest(spark):
    said = "</s>[INST] ok [/INST]"
    rows = [(1, 1, "assistant", "yes\\"), (1, 0, "user", None), (2, 0, "user", said), (2, 1, "assistant", said), (2, 1, "assistant", said), (None, 5, None, "x"), (3, None, "tool", ""), (4, 0, "assistant", prose(1, 20000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS seq", "2 AS piece")
    got = {r["conv_id"]: r for r in chat.digest(chat.render(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    sha = (lambda turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
    assert got[1]["turns_sha256"] == sha([("user", ""), ("assistant", "yes\\")]) and got[1]["loss_chars"] == 4
    assert got[2]["n_turns"] == 3 and got[2]["loss_sha256"] == hashlib.sha256((said * 2).encode()).hexdigest()
    assert got[None]["turns_sha256"] == sha([("", "x")])
    assert chat.digest(chat.render(df.limit(0))).count() == 0


def test_schedule_is_fair_and_whole():
    rng = random.Random(3)
    for _ in range(150):
        weights = {f"s{i}": rng.randrange(1, 9) for i in range(rng.randrange(1, 7))}
        blocks = {s: rng.randrange(40) for s in weights}
        used = {}
        for phase in mixing.phases(weights, blocks):
            total, end = sum(weights[s] for s in phase["keys"]), phase["at"]
            for s, (first, last, slots) in phase["keys"].items():
                for i in range(last - first):
                    t = phase["at"] + i // len(slots) * phase["q"] + slots[i % len(slots)]
                    assert t not in used
                    used[t], end = s, max(end, t + 1)
            for s in phase["keys"]:
                done = 0
                for t in range(phase["at"], end):
                    done += used[t] == s
                    assert abs(done - weights[s] / total * (t + 1 - phase["at"])) < 1
        assert sorted(used) == list(range(sum(blocks.values())))


def test_mix_keeps_every_row(spark):
    rows = [(k, "x", "en", "abc"[k % 7 % 3]) for k in range(700)] + [(k, None, "en", None) for k in range(700, 720)] + [(5, "x", "en", "b"), (None, "x", "en", "a")]
    df = docs(spark, rows, extra=True).withColumnRenamed("rank", "mix_key_")
    for bucket in (50_000, 20):
        got = mixing.mix(df, {"a": 3, "b": 1, "c": 2}, other=1, block_rows=8, bucket_rows=bucket).collect()
        assert sorted((r["doc_id"] or -1, r["source"] or "") for r in got) == sorted((r[0] or -1, r[3] or "") for r in rows)
        by: dict = {}
        for r in got:
            by.setdefault(r["mix_slot_"], set()).add((r["source"], r["mix_block_"]))
        assert sorted(by) == list(range(len(by))) and all(len(v) == 1 for v in by.values())
        assert max(Counter(r["mix_slot_"] for r in got).values()) <= 8
    ordered = [r["doc_id"] for r in mixing.in_order(mixing.mix(df, {"a": 3})).collect()]
    assert len(ordered) == len(rows)
    assert mixing.mix(docs(spark, []), {"a": 1}).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(df, {"a": 0})


def brute(rows, asked, k):
    out = {}
    for q, v in asked:
        a = np.array(v)
        best = sorted((-float(a @ np.array(w) / np.sqrt((a @ a) * (np.array(w) @ np.array(w)))), i) for i, w in rows if i != q)
        out[q] = [i for _, i in best[:k]]
    return out


def test_neighbours_are_exact_at_factor_one(spark):
    rng = np.random.RandomState(4)
    rows = [(k, [float(x) for x in rng.randn(8)]) for k in range(400)]
    rows += [(1000 + k, rows[0][1]) for k in range(12)]
    odd = [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] + [1.0] * 7), (2004, []), (2005, [1.0, 2.0]), (None, [1.0] * 8), (3, rows[3][1])]
    df = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").selectExpr("*", "1 AS shard", "2 AS v")
    asked = df.where("vec_id % 50 = 0 OR vec_id > 2000")
    got: dict = {}
    for r in ann.search(df, asked, k=5, factor=1.0, shard_rows=60).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    assert got == want
    assert got[0] == [1000, 1001, 1002, 1003, 1004]
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert ann.search(few, few, k=5).count() == 6
    assert ann.search(few.limit(0), few.limit(0)).count() == 0


def test_recall_of_the_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got: dict = {}
    for r in queries.op9_neighbours(spark, sf).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert np.mean([len(got[q] & set(want[q])) / 5 for q in want]) >= 0.9
