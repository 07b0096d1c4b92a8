import hashlib
import re

import pyarrow.parquet as pq
import pytest

from quernstone.llm import decontaminate as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def word_list(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(rows, items, window=10):
    windows = {}
    for name, t in items:
        w = word_list(t)
        k = min(window, len(w))
        for j in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(str(name))
    out = []
    for d, t in rows:
        w, hit, found = word_list(t), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if (names := windows.get(tuple(w[i : i + k]))) is not None:
                    hit |= set(range(i, i + k))
                    found |= names
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()), key=str)


@pytest.mark.parametrize("block,each", [(1 << 24, 4), (700, 3), (1500, 100)])
def test_against_brute_force(spark, docs_of, small, block, each, monkeypatch):
    monkeypatch.setattr(op, "PASS_BLOCKS", each)
    t = pq.read_table("/root/testdata/sf0.001/benchmark.parquet").to_pydict()
    items = [*zip(t["item_id"], t["text"]), (500, "Short one"), (501, None), (502, "..."), (503, t["text"][0]), (504, "été À la Mode déjà vu")]
    long = " ".join(t["text"])
    rows = [*small, (900, None), (901, ""), (902, "a short ONE, and short-one"), (903, t["text"][0].upper()), (904, long * 5), (904, long), (905, "l'été À la mode déjà vu!"), (906, "short"), (None, "short one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert got(op.contamination(docs_of(rows), bench, block_bytes=block)) == brute(rows, items)
    dirty = {d for d, *_, bad in brute(rows, items) if bad}
    kept = op.decontaminate(docs_of(rows), bench, block_bytes=block)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {r.doc_id for r in kept.collect()} == {d for d, *_, bad in brute(rows, items) if not bad}
    assert None in dirty


def test_empty_tables(spark, docs_of):
    bench = spark.createDataFrame([(1, "some words of a benchmark item here")], "item_id long, text string")
    assert op.contamination(docs_of([]).limit(0), bench).count() == 0
    clean = op.contamination(docs_of(["some words of a benchmark item here"]), bench.limit(0)).first()
    assert (clean.n_words, clean.n_hit, clean.contaminated) == (7, 0, False)


def test_longest_run_and_spans(spark, docs_of):
    item = " ".join(f"w{i}" for i in range(30))
    r = op.contamination(docs_of(["x y " + item + " z"]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (r.longest, [list(s) for s in r.spans], r["items"]) == (30, [[2, 32]], ["1"])


def brute_longest(text, items, window=10):
    """Words, place and item of the longest run of words that a text and an item share."""
    w, best = word_list(text), (0, None, None)
    for name, t in items:
        v = word_list(t)
        least = min(window, len(v))
        for i in range(len(w)):
            for j in range(len(v)):
                n = 0
                while i + n < len(w) and j + n < len(v) and w[i + n] == v[j + n]:
                    n += 1
                if n and n >= least and (-n, i, name) < (-best[0], best[1] if best[0] else 0, best[2] or ""):
                    best = (n, i, name)
    return best


@pytest.mark.parametrize("block", [1 << 24, 60])
def test_longest_verbatim_match(spark, docs_of, block):
    a, b = (" ".join(f"{x}{i}" for i in range(25)) for x in "ab")
    part = lambda t, i, j: " ".join(t.split()[i:j])
    items = [("1", a), ("2", b), ("3", part(a, 5, 20) + " " + part(b, 0, 14)), ("4", "lone word")]
    texts = [part(a, 0, 10) + " " + part(b, 3, 13), a + " x " + b, part(a, 3, 25), part(a, 8, 20) + " " + part(b, 0, 25), "a lone word", part(a, 0, 9), "", part(b, 0, 12) + " y " + part(b, 13, 25)]
    got = {r.doc_id: (r.longest, r.longest_at, r.longest_item) for r in op.contamination(docs_of(texts), spark.createDataFrame(items, "item_id string, text string"), block_bytes=block).collect()}
    assert got == {k: brute_longest(t, items) for k, t in enumerate(texts)}
    assert got[0][0] == 10


def test_null_ids_and_clashing_columns(spark, docs_of):
    t = " ".join(f"w{i}" for i in range(12))
    bench = spark.createDataFrame([(None, t), ("null", t), ("x", t), ("x", t)], "item_id string, text string")
    docs = docs_of([t, t]).selectExpr("concat('d', doc_id) AS doc_id", "text", "1 AS uid", "2 AS spans", "3 AS items", "4 AS longest")
    got = op.contamination(docs, bench).collect()
    assert [(r.n_items, list(r["items"])) for r in got] == [(3, ["null", "null", "x"])] * 2
    assert op.decontaminate(docs, bench).count() == 0 and op.decontaminate(docs, bench.limit(0)).columns == docs.columns
