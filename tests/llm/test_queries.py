"""The registered queries, called as registered, against DuckDB or brute force."""

import glob
import hashlib
import os
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from test_scans import ACCESS, ASSIGN, HEX, base

from sessionloom.llm import _bpe, queries
from sessionloom.llm.oracle import oracle_sql

FOLDER = "/root/testdata/sf0.001"
KINDS = ("assign", "access", "hex")


@pytest.fixture(scope="module")
def texts():
    frame = pd.concat(pd.read_parquet(p) for p in sorted(glob.glob(f"{FOLDER}/documents.parquet*")))
    return {int(i): t if isinstance(t, str) else "" for i, t in zip(frame.doc_id, frame.text)}


@pytest.fixture(scope="module")
def ids(texts):
    tok = _bpe.load_tokenizer(queries.vocabulary())
    return {i: tok.encode(t, add_special_tokens=False).ids for i, t in texts.items()}


def result(spark, name):
    return queries.queries()[name](spark, FOLDER).toPandas()


@pytest.mark.parametrize("name", list(oracle_sql()))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want, got = con.execute(oracle_sql()[name]).df(), result(spark, name)
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    plain = lambda frame: sorted(map(tuple, frame[columns].astype(str).itertuples(index=False)))
    assert plain(got) == plain(want)


def test_op1(spark, texts):
    got = result(spark, "op1_secret_scan")
    assert len(got) == len(texts)
    for r in got.itertuples():
        found = base(texts[r.doc_id])
        named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in found) for i in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == named
    assert ASSIGN and ACCESS and HEX


def test_op2_and_op6(spark, texts, ids):
    got = {r.doc_id: r for r in result(spark, "op2_bpe_codec").itertuples()}
    counts = {r.doc_id: r for r in result(spark, "op6_token_counts").itertuples()}
    assert set(got) == set(counts) == set(texts)
    for i, t in texts.items():
        assert got[i].n_tokens == counts[i].n_tokens == len(ids[i])
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids[i], "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
        assert (counts[i].n_bytes, counts[i].over_limit) == (len(t.encode()), len(ids[i]) > 1024)


def test_op5(spark, ids):
    got = result(spark, "op5_best_fit_packing")
    for doc, own in got.groupby("doc_id"):
        whole, own = np.array([*ids[doc], 0], "<u4"), own.sort_values("piece")
        assert own.piece.tolist() == list(range(len(own))) and own.start.tolist() == (own.length.cumsum() - own.length).tolist()
        assert own.length.sum() == len(whole) and (len(own) == 1 or (own.length.iloc[1:] == 2048).all())
        assert [zlib.crc32(whole[a : a + n]) for a, n in zip(own.start, own.length)] == own.ids_crc32.tolist()
    assert set(got.doc_id) == set(ids)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.length.sum() <= 2048 and (own.offset == own.length.cumsum() - own.length).all()
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_op8(spark, texts):
    got = result(spark, "op8_toxicity")
    assert set(got.doc_id) == set(texts) and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert (got.predicted == (got.score >= 0.5)).all()


def test_op9(spark, ids):
    got, at = result(spark, "op9_token_records").sort_values("doc_id"), 0
    assert got.doc_id.tolist() == sorted(ids)
    for r in got.itertuples():
        own = np.array([*ids[r.doc_id], 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), zlib.crc32(own))
        at += len(own)
