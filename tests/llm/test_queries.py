"""Every query against its SQL, or against a brute-force version where SQL has none."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from plumbline.llm.catalog import ORACLES, QUERIES, VOCABULARY

from .. import compare

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF)


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    assert compare.actual(df) == compare.expected(con, ORACLES[name])
    assert not compare.kinds(df, con, ORACLES[name])


def components(nodes, links):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def brute_fingerprint(text, width=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    if not words:
        return 0
    grams = [" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    ids = sorted(fps)
    links = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    want = components(ids, links)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, SF).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def brute_repeats(texts, width=35):
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    seen = Counter(tuple(w[k:k + width]) for w in words.values() for k in range(len(w) - width + 1))
    out = {}
    for i, w in words.items():
        gone = {k + j for k in range(len(w) - width + 1) if seen[tuple(w[k:k + width])] > 1 for j in range(width)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring(spark, texts):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op3_substring"](spark, SF).collect()}
    assert got == brute_repeats(texts)
    assert any(r[1] for r in got.values())


def test_language_accuracy(spark, con):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op6_language"](spark, SF).collect()
    assert {r.doc_id: r.held_out for r in rows} == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in lang}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_sentencepiece_equals_the_library(spark, texts):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)
    rows = QUERIES["op9_sentencepiece"](spark, SF).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: model.encode(t) for i, t in texts.items()}
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in rows)


def test_embeddings(spark, con):
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    links = defaultdict(int)
    for i in range(len(rows)):
        links[rows[i][0]] = int(near[i].sum())
    want = components([r[0] for r in rows], [(rows[i][0], rows[j][0]) for i, j in zip(*np.nonzero(near), strict=True)])
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op10_embeddings"](spark, SF).collect()}
    assert got == {i: (links[i], want[i], i == want[i]) for i, _ in rows}
