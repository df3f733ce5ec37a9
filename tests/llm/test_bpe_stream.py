import hashlib
import random
import struct

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from skyframe.llm import bpe_stream, bpe_tables

PATH = bpe_tables.default_vocabulary()
TOK = Tokenizer.from_file(PATH)
TABLES = bpe_tables.load(PATH)
ENC, DEC = bpe_stream.StreamEncoder(TABLES), bpe_stream.StreamDecoder(TABLES)


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def same(text, cuts=()):
    want = TOK.encode(text, add_special_tokens=False).ids
    out = b""
    for a, b in zip([0, *cuts], [*cuts, len(text)]):
        out += ENC.feed(text[a:b])
    got = ids(out + ENC.finish())
    assert got == want, (text[:80], cuts)
    assert DEC.decode(struct.pack(f"<{len(want)}I", *want)) == TOK.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab sSrelvtmd'\n\t.1é漢<|endoftx>  ", max_size=40), st.lists(st.integers(0, 40), max_size=4))
def test_any_blocks(text, cuts):
    same(text, sorted(min(c, len(text)) for c in cuts))


def test_special_and_edges():
    for text in ["", " ", "<|endoftext|>", "a<|endoftext|> b", "<|endo", "it's <|endoftext|><|endoftext|>  x", "\n\n a", "🙂" * 50]:
        same(text)
        same(text, range(1, len(text)))


def test_long_runs():
    rng = random.Random(3)
    words = ["the", "ing", "tion", "er", "an", "q", "zx", "aaaa", "Straße"]
    letters = "".join(rng.choice(words) for _ in range(9000))
    for text in [letters, " " + letters + "!", "a" * 30_000, " " * 20_000, " " * 20_000 + "b", "\n" * 9000 + "x", "=" * 12_000 + "'s", "x" + "7" * 9000 + " y", letters + " " * 5000 + letters, "漢" * 6000]:
        same(text, [len(text) // 3, len(text) // 2])
        for k in range(0, len(text), 5000):
            same(text[k : k + 7000])


def test_state_is_small():
    enc = bpe_stream.StreamEncoder(TABLES)
    for _ in range(40):
        enc.feed("thingering" * 800)
        assert len(enc.text) + len(enc.tail) < 3 * enc.window


def test_broken_ids():
    rng = random.Random(1)
    for _ in range(300):
        some = [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(30)]
        assert DEC.decode(struct.pack("<30I", *some)) == TOK.decode(some, skip_special_tokens=False)


def test_documents(spark, sf):
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for row in bpe_stream.op3_bpe(spark, sf).collect():
        want = TOK.encode(docs[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["n_tokens"] == len(want)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(want)}I", *want)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(TOK.decode(want, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (None, ""), (2, "a b"), (2, "a b")], "doc_id long, text string").selectExpr("*", "1 AS ids", "2 AS decoded")
    rows = bpe_stream.decode_documents(bpe_stream.encode_documents(docs)).collect()
    assert sorted((r["n_tokens"], r["decoded"]) for r in rows) == [(0, ""), (0, ""), (2, "a b"), (2, "a b")]
    assert sorted(map(tuple, bpe_stream.encode_and_decode(docs).collect()), key=str) == sorted(map(tuple, rows), key=str)
    assert bpe_stream.encode_documents(docs.limit(0)).count() == 0
