"""Secrets and toxicity on small tables; the pipeline end to end."""

import random
import re
import secrets as random_secrets

import pytest
from pyspark.sql import functions as F

from sessionloom.llm import secrets, toxicity

ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def base(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= 32]
    return sorted(out)


def odd_texts():
    pick = random.Random(1)
    bits = ["password", "Passwd", "api_key", "APIKEY", "token", '"', "'", " ", "=", ":", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "é", "😀", "abc.def-", "\n", "zz"]
    return ["".join(pick.choice(bits) for _ in range(pick.randint(0, 30))) for _ in range(500)] + [None, ""]


def test_patterns(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, secrets string")
    got = {r.doc_id: r.secrets for r in secrets.find_secrets(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert [(s.start, s.order, s.end) for s in got[i].base] == base(t)
        assert [s for s in got[i].spans if s.order < 3] == got[i].base
    assert secrets.find_secrets(df.where("false")).collect() == []


def test_battery_finds_random_tokens_and_leaves_words(spark):
    pick = random.Random(7)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(pick.choice(letters) for _ in range(40)) for _ in range(40)]
    words = ["internationalizationlayer", "/usr/share/application-data/locale", "getCustomerAccountBalanceById", "=" * 40, "1" * 30, "abcabcabcabcabcabcabcabc", "12345678901234567890"]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys)] + [(100 + i, f"see {w} here") for i, w in enumerate(words * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.secrets.spans for r in secrets.find_secrets(df).collect()}
    hit = [i for i in range(40) if [(s.start, s.end, s.kind) for s in got[i]] == [(4, 44, "random")]]
    assert len(hit) >= 36
    assert all(not got[i] for i in got if i >= 100)


def test_redaction(spark):
    rows = [(1, "é password: hunter2hunter2 end", 5, "k"), (2, None, 0, "k"), (3, "plain", 5, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, lang string")
    got = {r.doc_id: r for r in secrets.redact(df).collect()}
    assert (got[1].text, got[1].n_chars) == ("é [SECRET] end", 14)
    assert got[2].text is None and got[3].text == "plain" and df.columns == secrets.redact(df).columns


def test_toxicity(spark):
    pick = random.Random(3)
    clean = ["table", "river", "summer", "letter", "garden", "window", "music", "paper"]
    bad = ["grumbledork", "snarfwit"]
    rows, labels = [], []
    for i in range(600):
        words = [pick.choice(clean) for _ in range(pick.randint(3, 60))]
        toxic = i % 4 == 0
        if toxic:
            words[pick.randrange(len(words))] = pick.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, None), (1001, ""), (1002, "grumbledork " * 3000), (1003, "garden " * 30000), (None, "river")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(labels[:400] + [(None, 1), (5, None)], "doc_id long, label int")
    model = toxicity.fit(df, known)
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    assert len(got) == len(rows)
    wrong = [i for i, y in labels[400:] if (got[i] >= 0.5) != bool(y)]
    assert len(wrong) <= 2
    assert got[1002] > 0.5 > got[1003] and got[1000] == got[1001]
    kept = {r.doc_id for r in toxicity.drop_toxic(df, model).collect()}
    assert kept == {i for i, s in got.items() if s < 0.5}


def test_toxicity_without_classes(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, label int"))
    assert toxicity.score(df, none).first().score == pytest.approx(toxicity.UNTAUGHT)
    one = toxicity.fit(df, spark.createDataFrame([(1, 0)], "doc_id long, label int"))
    assert toxicity.score(df, one).first().score == pytest.approx(1 / 3)
    assert toxicity.score(df.where("false"), one).collect() == []


def test_pipeline_catches_what_is_planted(spark, tmp_path):
    import corpus_pipeline as P

    pick = random.Random(9)
    vocabulary = ["".join(pick.choice("abcdefghij") for _ in range(pick.randint(3, 8))) for _ in range(800)]
    prose = lambda n: " ".join(pick.choice(vocabulary) for _ in range(n))
    passage, key = prose(60), random_secrets.token_hex(20)
    texts = [prose(150) for _ in range(60)]
    texts += [prose(40) + " " + passage + " " + prose(40) for _ in range(4)]
    near = texts[0].split()
    near[75] = "changed"
    texts += [texts[1], " ".join(near), f"key {key} " + prose(50)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in P.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now
    assert seen["toxicity"].count() == len(texts)
    assert {r.doc_id for r in seen["near_duplicates"].collect()} == set(range(64)) | {66}
    cut = {r.doc_id: r.text for r in seen["repeated_passages"].collect()}
    assert all(passage not in t for t in cut.values()) and cut[5] == texts[5]
    assert key not in seen["secrets"].where(F.col("doc_id") == 66).first().text
    assert seen["secrets"].columns == docs.columns
    assert now.select("doc_id").distinct().count() == len(cut)


def test_near_duplicates_are_rows_not_ids(spark, tmp_path):
    import corpus_pipeline as P

    a, b, c = ("".join(x + str(i) + " " for i in range(40)) for x in "abc")
    rows = [(1, a), (5, b), (1, b), (7, c), (None, c), (None, "x y z"), (None, "x y z"), (8, None), (None, None), (9, "")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = P.near_duplicates(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = [(1, a), (1, b), (7, c), (8, None), (9, ""), (None, None), (None, "x y z")]
    assert sorted(map(repr, got.select("doc_id", "text").collect())) == sorted(f"Row(doc_id={i!r}, text={t!r})" for i, t in want)


def test_pipeline_with_nulls_repeats_and_clashes(spark, tmp_path):
    import corpus_pipeline as P

    pick = random.Random(4)
    word = lambda: "".join(pick.choice("abcdefghijé") for _ in range(6))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, long, one, two = prose(80), prose(400), prose(60), prose(60)
    texts = [None, "", " \n ", prose(3), long, long, one + "x" + passage + "é", two + "é" + passage, passage]
    rows = [(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", i) for i, t in enumerate(texts)]
    rows += [(4, long, "en", "s", 5, "a", "b", "c", "d", 1), (None, None, None, None, None, None, None, None, None, None)]
    columns = "doc_id long, text string, lang string, source string, n_chars long, spans string, kept string, secrets string, row string, row_key long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, some in (("some", rows), ("none", [])):
        now = spark.createDataFrame(some, columns)
        for k, (stage, f) in enumerate(P.STAGES):
            f(spark, now, str(tmp_path)).write.parquet(str(tmp_path / f"{name}{k}"))
            now = spark.read.parquet(str(tmp_path / f"{name}{k}"))
            if k < 4:
                assert now.columns == spark.createDataFrame([], columns).columns, stage
            if k == 2 and some:
                left = {r.doc_id: r for r in now.collect()}
                assert set(left) == {0, 1, 2, 3, 4, 6, 7, None}
                assert (left[6].text, left[7].text, left[6].spans, left[6].n_chars) == (one + "xé", two + "é", "a", len(one) + 2)
                assert left[0].text is None and left[1].text == "" and left[4].text == long
        assert now.count() == len(left) if some else now.count() == 0


def test_false_discoveries_are_few(spark):
    pick = random.Random(11)
    parts = "get set user account value list item name total order data cache file path load save index page view model state test".split()
    joins = [lambda w: "_".join(w), lambda w: "/".join(w), lambda w: "-".join(w), lambda w: "".join(x.title() for x in w), "".join]
    words = ["".join(pick.choice(joins)([pick.choice(parts) for _ in range(pick.randint(5, 12))])) for _ in range(4000)]
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(pick.choice(letters) for _ in range(pick.choice((32, 40, 64)))) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([f"a {w} b" for w in words + keys])], "doc_id long, text string")
    hit = {r.doc_id for r in secrets.find_secrets(df).collect() if any(s.kind == "random" for s in r.secrets.spans)}
    false, true = len([i for i in hit if i < 4000]), len([i for i in hit if i >= 4000])
    assert true >= 150 and false <= 0.02 * len(hit) + 1


def test_toxicity_of_long_texts_and_repeated_ids(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    pick = random.Random(5)
    text = "".join(pick.choice("abc é") for _ in range(5000))
    table = np.arange(1 << toxicity.BITS, dtype=np.int32)
    whole = toxicity.present(pa.array([text, None, text[:50]]), table, 1 << toxicity.BITS)
    monkeypatch.setattr(toxicity, "WINDOW", 700)
    parts = toxicity.present(pa.array([text, None, text[:50]]), table, 1 << toxicity.BITS)
    assert all((a == b).all() for a, b in zip(whole, parts))
    rows = [(i, ("bad" if i % 2 else "good") + f" word{i % 7}") for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    one = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    many = toxicity.fit(spark.createDataFrame(rows * 20, "doc_id long, text string"), labels.unionByName(labels))
    assert one.buckets.tolist() == many.buckets.tolist() and one.weights == pytest.approx(many.weights)
