import random
import re
from collections import Counter, defaultdict

import pytest

from quernstone.llm import collocations as op


def brute(rows, least, depth=5, within=100, most=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = [x for x in re.split("[\x20\x09]", piece) if x]
            n[lang] += len(w)
            for k in range(1, depth + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inner = set()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    if 100 * a >= within * found[p[i : i + m]]:
                        inner.add(p[i : i + m])
        rows = []
        for p, a in found.items():
            if p not in inner:
                score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    return sorted(map(tuple, op.collocations(docs, **options).collect()))


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["É", "a\x01b", "a", "A", "x\x00", " z", "ab"]
    langs = ["en", "de", None, "und", ""]
    out = []
    for k in range(n):
        words = [rng.choice(vocabulary[: 3 + k % 17]) for _ in range(rng.randrange(60))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", " ?"]) for w in words)
        out.append((langs[k % 5], text + (" fixed phrase of the house" if k % 3 else "")))
    return out


@pytest.mark.parametrize("options", [{"least": 4, "shard_bytes": 500}, {"least": 9, "depth": 3, "most": 5}, {"least": 5, "within": 60}, {"least": 1000}])
def test_against_brute_force(spark, options):
    rows = [*texts(150), ("en", None), ("en", ""), ("en", " \n"), ("fr", "."), ("en", "a b " * 4000), ("en", "no piece ends here " * 500)]
    want = brute(rows, **{k: v for k, v in options.items() if k != "shard_bytes"})
    assert got(spark, rows, **options) == want


def test_ranges_that_cut_through_a_prefix(spark):
    """Many ranges, so that a range's first nodes have their ancestors in the one before."""
    rows = texts(200, 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        assert got(spark, rows, least=3) == brute(rows, 3)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_products_past_64_bits(spark):
    docs = spark.createDataFrame([("en", ["a"], 4 * 10**12, [9 * 10**15]), ("en", ["a", "b"], 3 * 10**12, [9 * 10**15, 4 * 10**12])], "lang string, path array<string>, n long, left array<long>")
    size = docs.filter("size(path) = 2").selectExpr("cast(n as decimal(19,0)) * 1000 * cast(left[0] as decimal(19,0)) AS above", "cast(left[1] as decimal(19,0)) * cast(left[1] as decimal(19,0)) AS below")
    assert size.selectExpr("above div below AS s").first().s == 3 * 10**12 * 1000 * 9 * 10**15 // (16 * 10**24)


def test_tables_without_words_and_clashing_columns(spark):
    assert got(spark, []) == [] and got(spark, [("en", None), (None, "...")]) == []
    docs = spark.createDataFrame([("en", "a b, " * 5, 1, 2, 3)], "lang string, text string, path int, n int, left int")
    assert [r.phrase for r in op.collocations(docs, least=5).collect()] == ["a b"]


def test_a_long_text_is_cut_where_pieces_end():
    import numpy as np

    raw = np.frombuffer(b"aa bb. cc dd ee ff gg hh ii, jj kk", np.uint8)
    assert [p.tobytes() for p in op._cut(raw, 8)] == [b"aa bb.", b" cc dd ee ff gg hh ii,", b" jj kk"]
