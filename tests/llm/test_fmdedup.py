import hashlib
import random

import numpy as np
import pytest

from quernstone.llm import fmdedup as op
from quernstone.llm.anchors import Units


def brute(rows, window=20):
    rows = sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0, r[0]))
    seen, out = set(), []
    for _, (d, t) in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("heavy,shard,most", [(1 << 16, 4 << 20, 1 << 20), (3, 1000, 0)])
def test_against_brute_force(docs_of, small, heavy, shard, most):
    t = dict(small)
    rows = [*small, (500, None), (501, ""), (502, "x " * 3000), (503, "ab cd " * 400), (504, t[7]), (505, t[8] + " " + t[9]), (506, " ".join(t[10].split()[5:60])), (507, " ".join(f"w{i}" for i in range(19))), (508, " ".join(f"w{i}" for i in range(20))), (509, " ".join(f"w{i}" for i in range(20))), (None, t[11]), (7, t[12]), (7, t[12] + " " + t[7])]
    rows += [(600 + i, f"{i} a{i} b{i} " + " ".join(t[13].split()[: 8 + i % 30]) + f" c{i} d{i}" * 8) for i in range(60)]
    assert got(op.dedup(docs_of(rows), heavy=heavy, shard_bytes=shard, most=most)) == brute(rows)


def test_empty_table_and_clashing_columns(docs_of):
    assert op.dedup(docs_of([]).limit(0)).count() == 0
    clash = docs_of(["a b"]).selectExpr("doc_id", "text", "1 AS uid", "2 AS spans", "3 AS s", "4 AS e")
    assert op.dedup(clash).select("n_words").first()[0] == 2


def test_index_counts_and_ranks():
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 4, (30, 12)).astype(np.uint32)
    index = op.FmIndex(rows, 5)
    seq = index.symbols.ravel()
    tree = op.WaveletTree(seq, 3)
    for c in range(4):
        for i in (0, 1, 64, 65, len(seq)):
            assert tree.rank(np.array([c]), np.array([i]))[0] == (seq[:i] == c).sum()
    flat = [tuple(r) for r in index.symbols]
    for place, length, lo, hi in index.matching(index.symbols):
        for k, r in enumerate(flat):
            n = next((m for m in range(0, 6) if place + m == 12 or m == 5 or r[place + m] == 0), 5)
            assert length[k] == n
            if n:
                p = r[place : place + n]
                assert hi[k] - lo[k] == sum(q[i : i + n] == p for q in flat for i in range(12 - n + 1))


def test_every_window_has_an_anchor_and_equal_ones_agree():
    rng = random.Random(9)
    units = Units(20, 8, op.word_units)
    text = [f"w{rng.randrange(50)}" for _ in range(300)]
    text[200:260] = text[20:80]
    raw = " ".join(text).encode()
    h, of, _ = units.units(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    p = units.picked(h, of)
    starts = [(s, a) for a, b, e in zip(p.at, p.start, p.end) for s in range(b, e - 19)]
    assert [s for s, _ in starts] == list(range(len(text) - 19))
    assert all(s <= a <= s + 12 for s, a in starts)
    assert [a - s for s, a in starts if 20 <= s <= 60] == [a - s for s, a in starts if 200 <= s <= 240]


def test_words_that_share_half_a_hash_differ(docs_of):
    """Two words whose hashes have equal upper halves."""
    rows = [(k, " ".join(f"a{i}" if i != 12 else w for i in range(40))) for k, w in enumerate(("id102099", "id394005"))]
    half = [op.word_units(np.frombuffer(w.encode(), np.uint8), np.array([0, 8]))[0][0] for w in ("id102099", "id394005")]
    assert half[0] >> np.uint64(32) == half[1] >> np.uint64(32) and half[0] != half[1]
    assert got(op.dedup(docs_of(rows))) == brute(rows)
    assert [r.n_removed for r in op.dedup(docs_of(rows)).orderBy("doc_id").collect()] == [0, 27]


def test_the_index_alone_tells(docs_of, monkeypatch):
    rows = [(i, " ".join(f"w{k}" for k in range(40))) for i in range(4)]
    assert got(op.dedup(docs_of(rows))) == brute(rows)
    monkeypatch.setattr(op, "find", lambda window: lambda shard: [])
    assert all(r.n_removed == 0 for r in op.dedup(docs_of(rows)).collect())


def test_ids_of_any_type(docs_of):
    words = " ".join(f"w{k}" for k in range(30))
    docs = docs_of([words, words + " x", words]).selectExpr("concat('d', 9 - doc_id) AS doc_id", "text")
    assert {(r.doc_id, r.n_removed) for r in op.dedup(docs).collect()} == {("d7", 0), ("d8", 30), ("d9", 30)}
