import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyframe.llm import token_files
from skyframe.llm.bpe_tables import default_vocabulary
from skyframe.llm.pretokens import PieceEncoder

TOK = Tokenizer.from_file(default_vocabulary())
ENC = PieceEncoder(default_vocabulary())
ODD = ["", " ", "  ", "a", "it's we'll 'tis '' 's's \n's  's", "a\n\n b \t c   ", "x<|endoftext|>y", "é ñ 漢字 🙂 ٣ ½", "don't'll!'s", "  a 　b", "'", "a'", "l'r", "'re've'd 're", "12ab 34", "a" * 3000]


def check(texts):
    got = []
    for _, ids, offs in ENC.encode(pa.array(texts, pa.string())):
        got += [ids[a:b].tolist() for a, b in zip(offs[:-1], offs[1:])]
    assert got == [TOK.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_pieces():
    check([*ODD, None, *ODD[::-1]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="a bsSrelvtmd'\n\t.1é漢 ", max_size=24), max_size=5))
def test_pieces_random(texts):
    check(texts)


def expected(rows):
    start = 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(TOK.encode(r[1] or "", add_special_tokens=False).ids))):
        raw = b"".join(struct.pack("<I", i) for i in [*TOK.encode(text or "", add_special_tokens=False).ids, 2])
        yield (doc, start, len(raw) // 4, zlib.crc32(raw))
        start += len(raw) // 4


def test_round_trip(spark):
    rows = [(k * 3, t) for k, t in enumerate(ODD)] + [(None, "null id"), (9, None), (9, "same id twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "'x' AS frame")
    out = token_files.read_tokens(token_files.write_tokens(docs, docs_per_file=4)).collect()
    assert sorted(map(tuple, out), key=str) == sorted(expected(rows), key=str)
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0))).count() == 0


def test_documents(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, token_files.op9_token_files(spark, sf).collect())) == sorted(expected(rows))


def test_random_access_and_damage(tmp_path):
    import zstandard

    ids = [np.arange(k, dtype="<u4") for k in (3, 0, 50)]
    uri = f"file://{tmp_path}/f"
    out = token_files.TokenWriter(uri)
    for doc, x in zip([5, None, 7], ids, strict=True):
        out.add(doc, zstandard.ZstdCompressor().compress(x.tobytes()), x.nbytes, token_files._checksum(x.tobytes()))
    out.close()
    file = token_files.TokenFile(uri)
    assert file.doc_ids == [5, None, 7] and file.ids(2).tolist() == list(range(50))
    raw = bytearray((tmp_path / "f").read_bytes())
    raw[int(file.at[2]) + 12] ^= 1
    (tmp_path / "f").write_bytes(raw)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        token_files.TokenFile(uri).ids(2)


def test_hot_ids_take_several_ranges(spark, monkeypatch):
    """Most rows have one id or none: still many files, ids in order, every row once, starts without gaps."""
    rows = [(7, f"copy {k % 5}") for k in range(150)] + [(None, f"null {k}") for k in range(90)] + [(k, f"text number {k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for most in (4096, 5):
        monkeypatch.setattr(token_files, "MAX_RANGES", most)
        manifest = token_files.write_tokens(docs, docs_per_file=10)
        files = manifest.orderBy("part", "place").collect()
        assert len(files) >= 28 and max(f["n_docs"] for f in files) <= 10 and len({f["part"] for f in files}) <= most + 1
        # No range has a third of the rows when there are enough of them.
        assert most < 10 or max(sum(f["n_docs"] for f in files if f["part"] == p) for p in {f["part"] for f in files}) < 40
        start, order = 0, []
        for f in files:
            assert f["start"] == start
            start += f["n_ids"]
            order += token_files.TokenFile(f["uri"]).doc_ids
        assert order == sorted(order, key=lambda d: (d is not None, d or 0))
        out = sorted(map(tuple, token_files.read_tokens(manifest).collect()), key=lambda r: r[1])
        assert sorted([(r[0], *r[2:]) for r in out], key=str) == sorted([(d, n, c) for d, _, n, c in expected(rows)], key=str)
        assert [r[1] for r in out] == np.concatenate([[0], np.cumsum([r[2] for r in out])[:-1]]).tolist()


def test_ranges_are_in_order():
    ids = np.array([5, 5, 5, 5, 1, 9, 0, 7])
    got = token_files.ranges_of(ids, np.array([True] * 6 + [False, True]), np.array([2, 5, 5, 5, 8]), 2, 0)
    assert got.tolist() == [3, 4, 5, 3, 2, 7, 0, 6]
