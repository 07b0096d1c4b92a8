import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from quernstone.llm import columndedup as op


def brute(rows, window=200):
    n = Counter(b[i : i + window] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - window + 1))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if n[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        spans = len(bytes(gone).replace(b"\0", b" ").split())
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("heavy,shard,most", [(1 << 16, 1 << 18, 1 << 20), (3, 4000, 0)])
def test_against_brute_force(docs_of, small, heavy, shard, most):
    t = dict(small)
    rng = random.Random(6)
    line = "".join(rng.choice("abcdefgh ") for _ in range(230))
    rows = [*small[:120], (500, None), (501, ""), (502, "z" * 900), (503, "ab cd " * 100), (504, t[7]), (505, t[8] + " " + t[9]), (506, t[10][37:400]), (507, "y" * 199), (508, "q" * 200), (509, "é" * 101 + t[3][:300]), (None, t[11])]
    rows += [(600 + i, f"{i} before " + line[: 195 + i] + f" after {i}") for i in range(30)] + [(507, "y" * 199)]
    assert got(op.dedup(docs_of(rows), heavy=heavy, shard_bytes=shard, most=most)) == brute(rows)


@pytest.mark.parametrize("letters", [1, 2, 5])
def test_transform_sorts_all_suffixes_and_gives_the_segments_back(letters):
    rng = np.random.default_rng(3)
    segments = [rng.integers(97, 97 + letters, rng.integers(0, 60)).astype(np.uint8).tobytes() for _ in range(50)]
    t = op.Transform(segments)
    found, back = {}, {}
    for k, documents, at, symbols in t.rows():
        for d, r, c in zip(documents.tolist(), at.tolist(), symbols.tolist()):
            size = int(t.rest[d]) + op.EACH * (k - 1) if k else 0
            found[r] = segments[d // op.EACH][len(segments[d // op.EACH]) - size :]
            back[d] = [c, *back.get(d, [])]
    suffixes = [found[r] for r in range(len(found))]
    assert suffixes == sorted(suffixes)
    assert sorted(x for x in suffixes if x) == sorted(s[i:] for s in segments for i in range(len(s)))
    prefixes = t.prefixes.read()
    for a, b, n in zip(suffixes, suffixes[1:], prefixes[1:]):
        assert n == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
    # the symbols before the suffixes of one document are the segment
    for k, s in enumerate(segments):
        size = len(s) % op.EACH
        d = next(d for d in range(op.EACH * k, op.EACH * k + op.EACH) if t.rest[d] == (size or op.EACH))
        raw = b"".join(int(t.bytes[c]).to_bytes(op.EACH, "big") for c in back[d] if c)
        assert bytes(x - 1 for x in raw if x) == s


def test_the_index_alone_tells(docs_of, monkeypatch):
    rows = [(i, "".join(f"{k} " for k in range(200))) for i in range(4)]
    assert got(op.dedup(docs_of(rows))) == brute(rows)
    monkeypatch.setattr(op, "find", lambda window: lambda shard: [])
    assert all(r.n_removed == 0 for r in op.dedup(docs_of(rows)).collect())


def test_ids_of_any_type(docs_of):
    docs = docs_of(["a" * 200, "a" * 201]).selectExpr("concat('d', doc_id) AS doc_id", "text")
    assert {(r.doc_id, r.n_removed) for r in op.dedup(docs).collect()} == {("d0", 200), ("d1", 201)}


def test_empty_table_and_clashing_columns(docs_of):
    assert op.dedup(docs_of([]).limit(0)).count() == 0
    clash = docs_of(["a b"]).selectExpr("doc_id", "text", "1 AS uid", "2 AS spans", "3 AS s", "4 AS e")
    assert op.dedup(clash).select("n_bytes").first()[0] == 3
