import hashlib
import random

import numpy as np

from quernstone.llm import chunkprint as op


def by_hand(text: bytes):
    """The chunks of a text, a byte at a time."""
    out, at = [], 0
    while at < len(text):
        h = 0
        for i in range(at, len(text)):
            h = (2 * h + int(op.GEAR[text[i]])) & 0xFFFF
            size = i + 1 - at
            if size == op.LONGEST or i + 1 == len(text) or size >= op.SHORTEST and h < (op.STRICT if size < op.NORMAL else op.LOOSE):
                out.append(text[at : i + 1])
                at = i + 1
                break
    return out


def test_chunks_are_those_of_the_rolling_hash(small):
    texts = [t.encode() for _, t in small[:40]] + [b"", b"a", b"z" * 1000, bytes(range(256)) * 4]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    row, s, e = op.cuts(data, offsets)
    for k, t in enumerate(texts):
        own = sorted(zip(s[row == k], e[row == k]))
        assert [data[a:b].tobytes() for a, b in own] == by_hand(t)


def brute(rows):
    rows = sorted(enumerate(rows), key=lambda r: (r[1][0] is not None, r[1][0] or 0))
    rows = [r for _, r in rows]
    out = []
    for k, (d, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        a, b, c = op.prints([t.encode(), new.encode(), n.encode()])
        out.append((d, len(t), hashlib.sha256(new.encode()).hexdigest(), op.shown(a), op.shown(b), op.containment(a, b), op.containment(a, c)))
    return sorted(out, key=str)


def test_against_brute_force(docs_of, small):
    rows = [*small, (500, None), (501, ""), (502, "é" * 5000), (503, "x"), (504, small[0][1])]
    got = sorted((tuple(r) for r in op.edit_likeness(docs_of(rows)).collect()), key=str)
    for g, b in zip(got, brute(rows), strict=True):
        assert g == b, [(x[:40] if isinstance(x, str) else x, y[:40] if isinstance(y, str) else y) for x, y in zip(g, b) if x != y]


def test_small_tables_and_ties(docs_of):
    assert op.edit_likeness(docs_of([]).limit(0)).count() == 0
    r = op.edit_likeness(docs_of([(7, "alone in the table")])).first()
    assert (r.doc_id, r.near_next) == (7, 1.0)
    rows = [(1, "same"), (1, "same"), (None, "none"), (2, None)]
    got = op.edit_likeness(docs_of(rows)).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 4), ("1", 4), ("2", 0), ("None", 4)]


def test_containment_resists_shifts():
    rng = random.Random(3)
    t = bytes(rng.randrange(97, 123) for _ in range(20000))
    a, b, c = op.prints([t, b"inserted" + t[:9000] + b"!" + t[9000:], bytes(rng.randrange(97, 123) for _ in range(20000))])
    assert op.containment(a, b) > 0.97 and op.containment(a, c) == 0 and op.containment(a, a) == 1


def test_clashing_columns(docs_of):
    clash = docs_of(["one two", None]).selectExpr("doc_id", "text", *(f"'x' AS {c}" for c in ("bucket", "tail", "mark", "n_chars", "fingerprint")))
    assert sorted((r.doc_id, r.n_chars, r.near_next) for r in op.edit_likeness(clash).collect()) == [(0, 7, 0.0), (1, 0, 0.0)]
