"""Byte-level BPE against the library on whole texts, match by match on odd ones."""

import hashlib
import os
import random

import numpy as np
import pytest
import regex

public_tokenizers = pytest.importorskip("public_tokenizers")

from plumbline.llm import bpe  # noqa: E402
from plumbline.llm.catalog import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def codec():
    return bpe.read_codec(PATH, PATTERN)


def matched(codec, text):
    """Each match of the pattern encoded by itself."""
    out = []
    for m in regex.finditer(PATTERN, text):
        out += codec.encoding._encode_single_piece(m.group())
    return out


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_query(spark, codec):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op11_bpe"](spark, SF).collect()
    want = {}
    for i, text in texts.items():
        ids = codec.encoding.encode_ordinary(text or "")
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                   hashlib.sha256((text or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
    assert len(rows) == len(texts)


def test_cuts_do_not_change_ids(codec):
    short = bpe.Codec(codec.ranks, codec.pattern, long=8)
    draw = random.Random(5)
    letters = list("ab1 2  \n\n\t'sté!?.,;日本　\xa0\x1c\x85'tll")
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(70)))
        text = text[:9] + draw.choice([" ", "\n", " \n"]) * draw.randrange(20) + text[9:]
        want = codec.encoding.encode_ordinary(text)
        assert short.encode(text).tolist() == want
        assert "".join(p for p, _ in short.pieces(text)) == text
        assert short.decode(short.encode(text).tobytes()) == text.encode()


def test_very_long_texts(codec):
    for text in ("word " * 60_000, "x" + " " * 1_500_000 + "y z", " " * 1_500_000, "a" * 300_000, "ab1!" * 100_000):
        ids = codec.encode(text)
        assert codec.decode(ids.tobytes()) == text.encode()
    text = "x" + "\n" * 200_000 + "yes and no"
    assert codec.encode(text).tolist() == matched(codec, text)


def test_odd_rows(spark, codec):
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, "one two", "c", 3), (3, "one two", "c", 3), (None, "é\n", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, c0 int")
    coded = bpe.encode_decode(docs, codec)
    assert coded.columns == ["doc_id", "text", "c0", "ids", "decoded"]
    got = sorted((r.doc_id or 0, r.text, bytes(r.decoded).decode(), r.c0) for r in coded.collect() if r.text is not None)
    assert got == [(0, "é\n", "é\n", None), (2, "", "", 2), (3, "one two", "one two", 3), (3, "one two", "one two", 3)]
    assert [bytes(r.ids) for r in coded.filter("text is null").collect()] == [b""]
    apart = bpe.decode(bpe.encode(docs, codec), codec)
    assert sorted(map(str, apart.collect())) == sorted(map(str, coded.collect()))
    lists = {r.text: r.x for r in coded.select("text", bpe.unpacked(coded.ids).alias("x")).collect()}
    assert lists == {t: codec.encoding.encode_ordinary(t or "") for _, t, _, _ in rows}
    assert bpe.encode_decode(docs.limit(0), codec).count() == 0
    nothing = bpe.decode(spark.createDataFrame([(1, None)], "a int, ids binary"), codec)
    assert nothing.first().decoded is None
