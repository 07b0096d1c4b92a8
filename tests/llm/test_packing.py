import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quernstone.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, window=2048):
    """Each id in exactly one piece; sequences gapless and no longer than the window."""
    t = Tokenizer.from_file(PATH)
    want = sorted(tuple([*t.encode(x or "", add_special_tokens=False).ids, 1]) for _, x in rows)
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id, r.doc_tokens].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    of = defaultdict(list)
    for (d, x) in rows:
        of[d].append(np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4"))
    left = {d: sorted(map(len, v)) for d, v in of.items()}
    for (d, n), rs in pieces.items():
        same = [x for x in of[d] if len(x) == n]
        assert sum(r.length for r in rs) == n * len(same)
        for r in rs:
            assert any(zlib.crc32(x[r.start : r.start + r.length]) == r.ids_crc32 for x in same)
        if len(same) == 1:
            at = 0
            for r in sorted(rs, key=lambda r: r.start):
                assert r.start == at
                at += r.length
        left[d] = [x for x in left[d] if x != n]
    assert not any(left.values()) and want
    padded = 0
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at and n > 0
            at += n
        assert at <= window
        padded += 0 if at & (at - 1) == 0 else window - at
    return padded, len(seqs)


def test_round_trip(docs_of, small):
    rows = [*small, (500, None), (501, ""), (502, "It's <|endoftext|> don't 123 ½ ǅ\x0bx y"), (503, "word " * 9000), (3, "again"), (None, "no id")]
    got = op.pack(docs_of(rows), PATH).collect()
    assert check(rows, got)[0] == 0


def test_equal_lengths_and_empty(docs_of):
    rows = [(i, "one two three four five") for i in range(50)]
    assert check(rows, op.pack(docs_of(rows), PATH, window=16).collect(), 16)[0] == 0
    assert op.pack(docs_of([]).limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(12))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    window = rng.choice([16, 64, 2048])
    counts = {rng.randrange(1, window): rng.choice([1, 2, 7, 1000]) for _ in range(rng.choice([1, 3, 40]))}
    plan, seqs = op.Plan(counts, window), defaultdict(list)
    for rest, n in counts.items():
        for rank in range(n):
            at = 0
            for s, size, q, o in plan.pieces(rest, rank):
                assert s == at
                at += size
                seqs[q].append((o, size))
            assert at == rest
    assert sorted(seqs) == list(range(plan.sequences))
    short = 0
    for s in seqs.values():
        at = 0
        for o, size in sorted(s):
            assert o == at
            at += size
        assert at == window or at & (at - 1) == 0
        short += at < window
    assert short <= window.bit_length()


def test_fill_is_the_best_subset_sum():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(rng.randrange(1, 6))}
        target, sums = rng.randrange(1, 60), {0}
        for size, n in counts.items():
            sums = {s + k * size for s in sums for k in range(n + 1) if s + k * size <= target}
        need, best = op.fill(counts, -1, target)
        assert best == max(sums) == sum(s * n for s, n in need.items())
        assert all(n <= counts[s] for s, n in need.items())


def test_clashing_columns(docs_of):
    clash = docs_of(["one two", None]).selectExpr("doc_id", "text", *(f"'x' AS {c}" for c in ("uid", "part", "n", "rest", "nth", "full", "ids", "before")))
    out = op.pack(clash, PATH)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    assert sum(r.length for r in out.collect()) == 4
