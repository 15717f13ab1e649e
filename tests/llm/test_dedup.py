"""Near and exact duplicates against brute force."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import embedding_dedup, ngram_join, suffix_dedup, topk_search
from sessionloom.llm._components import components


def repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]).astype(int)))
        out.append((len(d), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(d, np.uint8)[~gone])))
    return out


@pytest.mark.parametrize("length,anchor,size", [(20, 6, 600), (20, 20, 1 << 20), (8, 2, 50)])
def test_repeated_bytes(spark, tmp_path, length, anchor, size):
    pick = random.Random(5)
    base = ["".join(pick.choice("abé ") for _ in range(pick.randint(0, 60))) for _ in range(12)]
    texts = ["".join(pick.choice(base) for _ in range(pick.randint(0, 4))) for _ in range(120)]
    texts += [None, "", "a" * 100, "ab" * 60, base[0] * 3]
    rows = [(i, t, i) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, spans long").repartition(3).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    got = {r.doc_id: r for r in suffix_dedup.repeated_bytes(df, length=length, anchor=anchor, chunk_bytes=size).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(repeats(texts, length)):
        assert (got[i].n_bytes, [(s.start, s.end) for s in got[i].spans], bytes(got[i].kept)) == want
    assert suffix_dedup.repeated_bytes(df.where("false")).collect() == []


def linked(sets, threshold):
    """{id: (least reachable id, links)} of {id: set}."""
    root = {i: i for i in sets}
    links = collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= threshold * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i in ids}


@pytest.mark.parametrize("leaf", [8, 1024])
def test_ngram_join(spark, leaf):
    pick = random.Random(2)
    word = lambda: "".join(pick.choice("abcdefg") for _ in range(4))
    texts = []
    for n in (60, 60, 60, 200):
        base = [word() for _ in range(n)]
        for _ in range(30):
            own = list(base)
            for _ in range(pick.randint(0, 2)):
                own[pick.randrange(n)] = word()
            texts.append(" ".join(own))
    texts += [" ".join(word() for _ in range(50)) for _ in range(30)]
    texts += [None, "", "  \n ", "one two", "one two", "one  two", "solo", texts[0], texts[0]]
    words = [(t or "").split() for t in texts]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in enumerate(words)}
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key long")
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.similar_documents(df, leaf=leaf).collect()}
    assert got == linked(sets, 0.8)
    none = ngram_join.similar_documents(df.where("false")).collect() if leaf == 8 else []
    assert none == []


def test_ngram_join_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "x y z")], "doc_id long, text string")
    got = collections.Counter(tuple(r) for r in ngram_join.similar_documents(df).collect())
    assert got == {(7, 7, 1, True): 1, (None, 7, 1, False): 1, (None, None, 0, False): 1}


def test_recall_estimate():
    for p, runs in ((0.3, 6), (0.9, 6), (0.05, 40)):
        mean = runs * p / (1 - (1 - p) ** runs)
        assert ngram_join._recall(mean, runs) == pytest.approx(1 - (1 - p) ** runs, abs=1e-6)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (20, 20)] + [(100, i) for i in range(101, 160)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = dict(tuple(r) for r in components(df, "a", "b").collect())
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, 20: 20} | {i: 100 for i in range(100, 160)}
    assert got == want


def odd_vectors():
    rng = np.random.default_rng(4)
    rows = []
    for label in (0, 1):
        for _ in range(20):
            centre = rng.standard_normal(16)
            for _ in range(rng.integers(1, 12)):
                rows.append((label, (centre + 0.05 * rng.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(0, rows[0][1]), (0, rows[0][1]), (1, rows[0][1]), (None, rows[0][1]), (0, None), (0, []), (0, [0.0] * 16)]
    rows += [(0, [float("nan")] + [1.0] * 15), (0, [float("inf")] + [1.0] * 15), (0, [None] + [1.0] * 15), (0, [1.0, 2.0])]
    return [(i, v, y) for i, (y, v) in enumerate(rows)]


def is_good(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)


def test_vectors(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, node string")
    root, links = {i: i for i, _, _ in rows}, collections.Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(i, np.array(v, float), y) for i, v, y in rows if is_good(v) and y is not None]
    for a, (i, u, y) in enumerate(good):
        for j, v, z in good[:a]:
            if y == z and len(u) == len(v) and u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.similar_vectors(df, neighbours=3).collect()}
    assert got == {i: (links[i], find(i), find(i) == i) for i, _, _ in rows}
    assert embedding_dedup.similar_vectors(df.where("false")).collect() == []


def tight_groups(sizes, cosine, dim=64, noise=0.004, seed=6):
    """Groups of distinct vectors; the centres of groups 2i and 2i+1 have the given cosine."""
    rng = np.random.default_rng(seed)
    rows = []
    for i, n in enumerate(sizes):
        if i % 2 == 0:
            u, w = np.linalg.qr(rng.standard_normal((dim, 2)))[0].T
        centre = u if i % 2 == 0 else cosine * u + np.sqrt(1 - cosine**2) * w
        rows += [centre + noise * rng.standard_normal(dim) for _ in range(n)]
    return np.array(rows)


def vector_truth(x, threshold=0.93):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    sets = {i: set(np.flatnonzero(near[i]).tolist()) for i in range(len(x))}
    least = {}
    for i in range(len(x)):
        if i not in least:
            left = [i]
            while left:
                j = left.pop()
                if j not in least:
                    least[j] = i
                    left += sets[j]
    return {i: (len(sets[i]), least[i]) for i in sets}


def vector_table(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


def test_saturated_groups_are_linked(spark, monkeypatch):
    # lists alone, without what an audit would add
    monkeypatch.setattr(embedding_dedup, "_recall", lambda *a: (1.0, None))
    x = tight_groups([20, 20, 15, 15], 0.945)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.similar_vectors(vector_table(spark, x)).collect()}
    assert got == vector_truth(x) and len({c for _, c in got.values()}) == 2


def test_audit_sees_small_groups(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "AUDIT", 60)
    x = np.concatenate([tight_groups([400], 1), tight_groups([1, 1] * 150, 0.95, noise=0, seed=8)])
    rows = [(i, 0, v.astype("<f4").tobytes()) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    single = spark.createDataFrame(rows, "node long, label long, unit binary")
    roots = spark.createDataFrame([(i, 0) for i in range(400)], "node long, root long")
    recall, missed = embedding_dedup._recall(single, roots, 0.93, 10)
    assert recall < 0.5 and missed.count() > 0


def test_missed_target_compares_all(spark, monkeypatch):
    empty = lambda vectors, *a: vectors.sparkSession.createDataFrame([], embedding_dedup.LISTS)
    monkeypatch.setattr(embedding_dedup, "_descended", empty)
    monkeypatch.setattr(embedding_dedup, "_recall", lambda *a: (0.5, None))
    x = tight_groups([1, 1] * 10, 0.95, noise=0)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.similar_vectors(vector_table(spark, x)).collect()}
    assert got == vector_truth(x)


def test_top_k(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(i % 90, v) for i, v, _ in rows], "vec_id long, embedding array<float>").repartition(3)
    good = [(i % 90, np.floor(64 * np.array(v, float)).astype(int)) for i, v, _ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = collections.Counter()
    for a, (i, u) in enumerate(good):
        if i % 20 == 0:
            near = sorted((-int(u @ v), j) for b, (j, v) in enumerate(good) if b != a and len(u) == len(v))[:5]
            want.update((i, k + 1, j, -s) for k, (s, j) in enumerate(near))
    got = topk_search.top_k(df, F.col("vec_id") % 20 == 0, k=5)
    assert collections.Counter(tuple(r) for r in got.collect()) == want
    assert topk_search.top_k(df.where("false"), F.col("vec_id") >= 0).collect() == []


def test_strings_that_sums_take_for_equal_stay(spark):
    parity = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = parity.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, parity), (2, other)], "doc_id long, text string")
    got = suffix_dedup.repeated_bytes(df, length=1024, anchor=1024).collect()
    assert all(r.spans == [] and bytes(r.kept).decode() == r.text for r in got)


def test_long_texts_in_windows(spark, monkeypatch):
    pick = random.Random(8)
    base = "".join(pick.choice("abcdefgh") for _ in range(400))
    texts = ["".join(pick.choice("abcdefgh") for _ in range(1500)) + base[:250], base + "".join(pick.choice("abcdefgh") for _ in range(700)), base * 4]
    runs = suffix_dedup.PART
    monkeypatch.setattr(suffix_dedup, "PART", 100)
    import pyarrow as pa

    table = pa.table({"text": pa.array(texts)})
    count = collections.Counter()
    for at, part in suffix_dedup._parts(table, 40, 16):
        for a, n in zip((part.first + at).tolist(), part.count.tolist()):
            count.update(range(a, a + n))
    ends = np.cumsum([len(t) for t in texts])
    want = [i for t, e in zip(texts, ends) for i in range(e - len(t), e - 39)]
    assert sorted(count) == want and set(count.values()) == {1} and runs > 100


def test_kept_characters_are_whole(spark):
    same = "é" * 30
    df = spark.createDataFrame([(1, "a" + same + "é"), (2, "Ã" + same + "b")], "doc_id long, text string")
    got = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.repeated_bytes(df, length=21, anchor=8, characters=True).collect()}
    assert all(set(t) <= set("abéÃ") for t in got.values())


def test_equal_chunks_stay_apart(spark):
    from sessionloom.llm._chunks import packed

    df = spark.createDataFrame([("x" * 100,)] * 40, "text string").repartition(2)
    keys = [bytes(r.chunk) for r in df.mapInArrow(packed(200), "chunk binary, packed binary").select("chunk").collect()]
    assert len(keys) == len(set(keys)) >= 10


def test_sorted_prefix_doubling_agrees(spark):
    pick = random.Random(12)
    base = ["".join(pick.choice("abé ") for _ in range(pick.randint(5, 60))) for _ in range(8)]
    texts = ["".join(pick.choice(base) for _ in range(pick.randint(0, 4))) for _ in range(60)] + [None, "", "a" * 90, base[0]]
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = {(r.doc, r["at"]) for r in suffix_dedup.repeated_by_sorting(df, length=21).collect()}
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(d[i : i + 21] for d in data for i in range(len(d) - 20))
    assert got == {(k, i) for k, d in enumerate(data) for i in range(len(d) - 20) if count[d[i : i + 21]] > 1}
