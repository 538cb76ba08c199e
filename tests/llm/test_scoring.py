"""Quality classifier and language identification."""

import random
import zlib

import numpy as np
import pytest

from tallyreef.llm import langid, quality, queries

from .helpers import ODD, docs

SF = "/root/testdata/sf0.01"


def good(k):
    return " ".join(random.Random(k).choice(["the", "river", "moves", "slowly", "past", "old", "stones", "and", "trees"]) for _ in range(60)).capitalize() + "."


def bad(k):
    return " ".join(random.Random(k).choice(["BUY", "NOW", "CHEAP"]) + "!!" for _ in range(60))


def test_quality_learns_and_bears_odd_texts(spark):
    rows = [(k, good(k) if k % 3 else bad(k)) for k in range(90)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)] + [(61, None)], "doc_id long, quality int")
    model = quality.train(docs(spark, rows), labels, rows=40)
    got = {r["doc_id"]: r["score"] for r in quality.score(docs(spark, rows, extra=True), model, ["doc_id"]).collect()}
    assert all((got[k] >= 0.3) == (k % 3 > 0) for k in range(60, 90))
    odd = quality.score(docs(spark, ODD, extra=True), model, ["doc_id"]).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert next(r["score"] for r in odd if r["doc_id"] == 1) == pytest.approx(model.prior)


def test_quality_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.train(docs(spark, ODD), none)
    assert {r["score"] for r in quality.score(docs(spark, ODD), model, ["doc_id"]).collect()} == {0.5}
    assert quality.score(docs(spark, []), model, ["doc_id"]).count() == 0


def test_blocked_neighbours_are_exact():
    rng = np.random.RandomState(0)
    w = rng.rand(300, quality.TERMS).astype(np.float32)
    m = quality.Model(w, (rng.rand(300) > 0.5).astype(float), np.ones(300), 16, 7)
    assert np.allclose(m.scores(w[:40], block=37), m.scores(w[:40], block=4096))


def test_quality_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op1_quality(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(r["quality"], got[r["doc_id"]]["predicted"]) for r in labels if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([a == b for a, b in held]) >= 0.97


def test_automaton_finds_all_factors():
    s = np.array([2, 3, 2, 2, 3, 4, 2, 3])
    a = langid.automaton(s, 6)
    own = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    rng = random.Random(1)
    for _ in range(500):
        t = tuple(rng.randrange(2, 5) for _ in range(rng.randrange(1, 6)))
        state = 0
        for c in t:
            state = a[state, c] if state >= 0 else -1
        assert (state >= 0) == (t in own)


def test_phrases_are_those_of_a_plain_parse():
    texts = {"a": ["abracadabra banana bandana abracadabra"], "b": ["zig zag zebra buzz fuzz"]}
    m = langid.Model(texts, 1000)
    query = ["abra zebra banana fuzz", "", "zzz 123", "qqq"]
    got, _ = m.phrases(query, piece=1000)
    for k, lang in enumerate(m.langs):
        source = m.alphabet.spelled(texts[lang][0]).tobytes()
        for text, n in zip(query, got[:, k], strict=True):
            s, at, count = m.alphabet.spelled(text).tobytes(), 0, 0
            while at < len(s):
                end = at + 1
                while end <= len(s) and s[at:end] in source and 0 not in s[at:end]:
                    end += 1
                at, count = max(end - 1, at + 1), count + 1
            assert n == count, (lang, text)


def test_language_of_odd_texts(spark):
    train = docs(spark, [(k, ("the cat sat on the mat with that hat " if k % 2 else "le chat est sur la table avec une souris ") * 5, "en" if k % 2 else "fr") for k in range(40)])
    model = langid.train(train)
    got = langid.identify(docs(spark, [*ODD, (20, "the hat on that cat", "fr"), (21, "la souris est sur une table"), (22, "ñ")], extra=True), model, ["doc_id"]).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD) + 3
    assert [by[k]["lang_pred"] for k in (1, 2, 3, 4)] == ["und"] * 4 and by[1]["score"] == 0
    assert (by[20]["lang_pred"], by[21]["lang_pred"]) == ("en", "fr")
    assert by[22]["lang_pred"] in ("en", "fr") and all(0 <= r["score"] <= 1 for r in got)
    empty = langid.train(docs(spark, []))
    assert {r["lang_pred"] for r in langid.identify(docs(spark, ODD), empty, ["doc_id"]).collect()} == {"und"}


def test_letters_beyond_the_frequent_ones_stay_apart():
    han = [chr(0x4E00 + k) for k in range(300)]
    kana = [chr(0x30A1 + k) for k in range(80)]
    rng = random.Random(3)
    m = langid.Model({"ja": ["".join(rng.choices(kana, k=3000))], "zh": ["".join(rng.choices(han, k=3000))], "en": ["the cat sat on the mat " * 100]}, 20_000)
    assert m.width <= 2 + 62 + langid.BASE
    rare = [c for c in han if not m.alphabet.own[ord(c)]]
    assert len({m.alphabet.spelled(c).tobytes() for c in rare}) == len(rare) > 100
    counts, _ = m.phrases(["".join(rng.choices(rare, k=60)), "".join(rng.choices(kana, k=60)), "the mat sat on the cat"])
    assert [m.langs[k] for k in counts.argmin(axis=1)] == ["zh", "ja", "en"]


def test_every_language_is_learned(spark):
    rows = [(k, " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}x" for _ in range(12)), f"l{k:03}") for k in range(130)]
    model = langid.train(docs(spark, rows))
    assert len(model.langs) == 130
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs(spark, rows), model, ["doc_id"]).collect()}
    assert all(got[k] == lang for k, _, lang in rows)
    with pytest.raises(ValueError):
        langid.train(docs(spark, rows), languages=100)


def test_language_held_out(spark):
    got = {r["doc_id"]: r for r in queries.op5_language(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    held = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in rows if got[r["doc_id"]]["held_out"]]
    assert len(held) > 200 and np.mean(held) >= 0.97
