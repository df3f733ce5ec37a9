import hashlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from skyframe.llm import token_alignment
from skyframe.llm.bpe_tables import default_vocabulary, to_bytes


@pytest.fixture(scope="module")
def sides():
    """Both libraries, called with whole texts, and the bytes of their entries."""
    import re

    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(default_vocabulary())
    tok.encode_special_tokens = True
    names = {i: t for t, i in tok.get_vocab().items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=token_alignment.default_model())
    a_bytes = {i: to_bytes(t) for i, t in names.items() if not t.startswith("<|")}
    b_bytes = {}
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        b_bytes[i] = bytes.fromhex(piece[3:5]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def tokens(text):
        """(start, end, id) of both sides, or nothing."""
        if not text:
            return [], []
        out = []
        for ids, known in ((tok.encode(" " + text, add_special_tokens=False).ids, a_bytes), (sp.encode(text), b_bytes)):
            at, rows, joined = 0, [], b""
            for i in ids:
                rows.append((at, at + len(known[i]), i))
                at += len(known[i])
                joined += known[i]
            if joined != (" " + text).encode():
                return [], []
            out.append(rows)
        return tuple(out)

    return tokens


def brute(rows, sides):
    """The query's rows, from sets of ends."""
    linked, facts = [], []
    for doc, text in rows:
        a, b = sides(text)
        end_a, end_b = {e: i for _, e, i in a}, {e: i for _, e, i in b}
        ends = sorted(set(end_a) & set(end_b))
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(i) for s, e, i in a if low < e <= end) + "|" + ",".join(str(i) for s, e, i in b if low < e <= end)) if len(a) < 3000 else None
            low = end
        pairs = [(end_a[e], end_b[e]) for e in ends]
        linked += pairs
        facts.append((doc, len(a), len(b), pairs, ";".join(groups) if len(a) < 3000 else fast_groups(a, b, ends)))
    counts = Counter(linked)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    out = []
    for doc, na, nb, pairs, groups in facts:
        digest = hashlib.sha256(groups.encode()).hexdigest() if pairs else ""
        out.append((doc, na, nb, len(pairs), len(pairs), sum(counts[p] == highest[p[1]] for p in pairs), sum(counts[p] for p in pairs), digest))
    return sorted(out, key=str)


def fast_groups(a, b, ends):
    """The same text by walking both lists once, for long texts."""
    out, x, y = [], 0, 0
    for end in ends:
        left, right = [], []
        while x < len(a) and a[x][1] <= end:
            left.append(str(a[x][2]))
            x += 1
        while y < len(b) and b[y][1] <= end:
            right.append(str(b[y][2]))
            y += 1
        out.append(",".join(left) + "|" + ",".join(right))
    return ";".join(out)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

ODD = [
    (1, None),
    (2, ""),
    (3, " "),
    (4, "   lead and  double   spaces \n\n\t tabs   "),
    (5, "<|endoftext|> and <s> </s> <unk> <0x41> are plain text"),
    (6, "Grüße, naïve café — ½ ﬁ ﬀ Ａ"),
    (7, "漢字かな交じり文 한국어 😀👍🏽 ‍ \U0001f9ec"),
    (8, "mark ▁ of the model"),
    (9, "nul \x00 and \x1f controls \x7f \u0085     ﻿"),
    (9, "repeated id"),
    (None, "repeated id"),
    (None, None),
    (10, "don't we'll I'VE 12345 67,890.12 !!!??? foo_bar(baz)[0] == 'x'"),
    (11, "é combining å " + "z" * 5_000),
    (12, "word " * 30_000 + "x" * 20_000),
    (13, "\n"),
    (14, "a\r\nb\rc"),
]


def test_odd_rows(spark, sides):
    docs = spark.createDataFrame(ODD, "doc_id long, text string").withColumn("n_a", F.lit("x")).withColumn("links", F.lit(1))
    aligned = token_alignment.align_documents(docs)
    out = token_alignment.with_link_counts(aligned.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2("groups", 256)).otherwise("")))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in out.withColumn("n_links", F.col("n_groups")).collect()), key=str)
    want = brute(ODD, sides)
    assert got == want
    assert sum(r[1] > 0 for r in got) > 8 and sum(r[1] == 0 for r in got) >= 4
    assert token_alignment.with_link_counts(token_alignment.align_documents(docs.limit(0))).count() == 0


def test_single_space_at_the_end(spark, sides):
    """A text's last space is a token of its own, also in front of another text of the batch."""
    rows = [(1, "abc "), (2, "a b "), (3, " "), (4, "x"), (5, "ends with two  "), (6, "漢 "), (7, "a\n ")]
    out = token_alignment.with_link_counts(token_alignment.align_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)))
    got = sorted((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_best"], r["count_sum"], hashlib.sha256(r["groups"].encode()).hexdigest()) for r in out.collect())
    assert got == [r[:4] + r[5:] for r in brute(rows, sides)] and all(r[1] > 0 for r in got)


def test_mark_before_spaces():
    """Ids of whole texts in which the model's mark for a space stands before spaces."""
    import pyarrow as pa
    import sentencepiece

    from skyframe.llm.pretokens import PrefixedEncoder

    model, texts = token_alignment.default_model(), ["a▁  b", "▁ ", " ▁", "x ▁ y ", "▁▁   z"]
    known = sentencepiece.SentencePieceProcessor(model_file=model)
    [(_, ids, bounds)] = PrefixedEncoder(model).encode(pa.array([" " + x for x in texts]))
    assert [ids[x:y].tolist() for x, y in zip(bounds[:-1], bounds[1:], strict=True)] == [known.encode(x) for x in texts]


def test_overlaps(spark, sides):
    """All pairs of tokens that share a byte, by comparing every token with every other."""
    some = [r for r in ODD if r[0] is not None and r[0] != 9 and len(r[1] or "") < 200]
    out = token_alignment.overlapping_tokens(spark.createDataFrame(some, "doc_id long, text string"))
    got = sorted(tuple(r) for r in out.collect())
    want = []
    for doc, text in some:
        a, b = sides(text)
        want += [(doc, i, x, j, y, e == h) for i, (s, e, x) in enumerate(a) for j, (g, h, y) in enumerate(b) if s < h and g < e]
    assert got == sorted(want) and any(not r[5] for r in got)


def test_linkable():
    first, second = [b"a", b"ab", b"b", b" ab", b"c"], [b"b", b"ab", b"xab", b"b"]
    slow = sorted((i << token_alignment.SECOND) | j for i, x in enumerate(first) for j, y in enumerate(second) if x.endswith(y) or y.endswith(x))
    assert token_alignment.linkable(first, second).tolist() == slow


def test_documents(spark, sf, sides):
    """The whole table against both libraries and sets of ends."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in token_alignment.op11_token_alignment(spark, sf).collect()), key=str)
    assert got == brute(rows, sides)
