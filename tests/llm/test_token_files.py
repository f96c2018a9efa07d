import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from llm_data import frame

from talkmill.llm import token_files as T
from talkmill.llm.common import new_path
from talkmill.llm.entries import tokenizer_file


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return [np.array([*e.ids, T.END_ID], "<u4") for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_digest(docs, rows):
    got = T.encode_documents(docs, tokenizer_file()).orderBy("start").collect()
    want = {}
    for (i, _, _), e in zip(rows, ids_of([t for _, t, _ in rows]), strict=True):
        want.setdefault(i, []).append((len(e), zlib.crc32(e.tobytes())))
    at = 0
    for r in got:
        assert r.start == at and (r.n_tokens, r.ids_crc32) in want[r.doc_id]
        at += r.n_tokens
    assert len(got) == len(rows)
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda x: (x is not None, x or 0))


ODD = ["  a  b\n\n c 's don't ''' \t\tx 12ab3 ½ 漢字 é", "<|endoftext|> a", "x<|endoftext|>", "<|endoftext|", "|>", "", " ", " \n", "x_y __ 'll'll ’tis", "\x1c a", "a \n  b", "ﬁ ǅ ª º µ × ÷", " a  b\u200bc", "١٢٣ 12 Ⅷ", "it'shere we're  've 'd\n'm", "'s", "' s", "a\t 's\t'tx", "é'sé «a» “b” – €5 … 1’s", "a   \n", "   ", "\n\nx\n \ny", "'re'", "''ll"]


@pytest.mark.parametrize("memo", [3, 1_000_000])
def test_pieces_are_the_library_s(rows, monkeypatch, memo):
    monkeypatch.setattr(T, "MEMO_PIECES", memo)
    rng = random.Random(2)
    texts = [t for _, t, _ in rows] + ODD + ["".join(rng.choice("ab'sdlrevmt1 \n\t_.éß—漢") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    want = ids_of(texts)
    encoder = T.Encoder(tokenizer_file())
    for size in (1, 7, 4000):
        for k in range(0, len(texts) if size > 1 else 300, size):
            flat, ends = encoder.encode(pa.array(texts, pa.string()).slice(k, size))
            got = np.split(flat, ends[:-1])
            assert [g.tolist() for g in got] == [w.tolist() for w in want[k : k + size]]


def test_blocks_keep_all_rows(monkeypatch):
    monkeypatch.setattr(T, "BLOCK_BYTES", 20)
    texts = ["x" * n for n in (0, 3, 30, 5, 5, 5, 5, 19, 1, 20, 21, 100)] + [None, "abc"]
    b = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    got = list(T._blocks(iter([b, b.slice(0, 0), b.slice(4)])))
    assert [t for g in got for t in g.column(1).to_pylist()] == texts + texts[4:]
    assert all(g.num_rows == 1 or sum(len(t or "") for t in g.column(1).to_pylist()[1:]) <= 20 for g in got) and len(got) > 5


def test_files_beyond_100000_keep_their_order(spark, monkeypatch):
    """Names whose order as texts isn't that of their numbers."""
    names = ["part-99998-x.orc", "part-99999-x.orc", "part-100000-x.orc", "part-100001-x.orc"]
    files = spark.createDataFrame([(k, 0, [k] * (k + 1), f) for k, f in enumerate(names)], "doc_id long, row long, ids array<int>, file string")
    monkeypatch.setattr(T, "read_tokens", lambda spark, path: files)
    assert [(r.doc_id, r.start) for r in T.token_digest(spark, "").orderBy("doc_id").collect()] == [(0, 0), (1, 1), (2, 3), (3, 6)]


def test_files_have_stripes_indexes_and_round_trip(spark, docs, rows, tmp_path):
    path = f"{tmp_path}/tokens"
    T.write_tokens(docs, f"file://{path}", tokenizer_file())
    files = sorted(tmp_path.glob("tokens/*.orc"))
    assert files and sum(orc.ORCFile(f).nrows for f in files) == len(rows)
    got = T.read_tokens(spark, f"file://{path}")
    assert {tuple(r.ids) for r in got.where("doc_id = 203").collect()} == {tuple(map(int, ids_of([t for i, t, _ in rows if i == 203])[0]))}
    plan = got.where("doc_id = 203")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,203)" in plan


def test_nothing(spark, empty):
    assert T.encode_documents(empty, tokenizer_file()).count() == 0
    assert new_path(spark, "x") != new_path(spark, "x")
    one = T.encode_documents(frame(spark, [(5, None, None)]), tokenizer_file()).first()
    assert (one.doc_id, one.start, one.n_tokens, one.ids_crc32) == (5, 0, 1, zlib.crc32((2).to_bytes(4, "little")))
