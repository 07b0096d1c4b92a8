import numpy as np

from quernstone.llm import anchors as A
from quernstone.llm.common import long_hash


class Fixed(A.Units):
    """Units whose grams are given."""

    def grams(self, h):
        return h[: len(h) - self.gram + 1]


def test_every_window_is_in_one_piece_whatever_the_hashes():
    rng = np.random.default_rng(1)
    for high in (1, 2, 1 << 40):
        h = rng.integers(0, high, 40, dtype=np.uint64) << np.uint64(24)
        of = np.array([0, 14, 14, 19, 20, 40])
        p = Fixed(6, 2, None).picked(h, of)
        seen = [(s, int(a), int(k)) for a, b, e, k in zip(p.at, p.start, p.end, p.key) for s in range(b, e - 5)]
        assert [s for s, _, _ in seen] == [s for a, b in zip(of[:-1], of[1:]) for s in range(a, b - 5)]
        for s, a, k in seen:
            upper = (h >> np.uint64(32))[s : s + 5]
            assert a == s + int(upper.argmin()) and k == int(h[a])


def test_parted_pieces_hold_each_window_once_and_equal_cores_have_equal_keys():
    rng = np.random.default_rng(2)
    payload = rng.integers(0, 3, 400).astype(np.uint8)
    units = Fixed(20, 4, None)
    h = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    p = units.picked(h, np.array([0, 400]))
    sums = units.sums(payload)
    for width in (5, 1):
        q = p.parted(units, sums, width)
        assert sorted(s for b, e in zip(q.start, q.end) for s in range(b, e - 19)) == list(range(381))
        assert all(a - 16 <= b and e - 20 <= a for a, b, e in zip(q.at, q.start, q.end))
    again = {}
    for b, e, k in zip(q.start, q.end, q.key):
        assert e - b == 20
        again.setdefault(int(k), set()).add(payload[b:e].tobytes())
    assert all(len(x) == 1 for x in again.values())


def test_long_hash_is_the_session_s(spark):
    rows = [(1, -2, 3), (0, 0, 0), (2**62, -(2**63), 7)]
    want = [r.h for r in spark.createDataFrame(rows, "a long, b long, c long").selectExpr("xxhash64(a, b, c) AS h").collect()]
    assert sorted(long_hash(*np.array(rows, np.int64).view(np.uint64).T).view(np.int64).tolist()) == sorted(want)
