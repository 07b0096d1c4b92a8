import random
import re
from collections import Counter
from math import log2, sqrt

from quernstone.llm import divergence as op

WHITE = "[\x20\x09-\x0d]"


def distance(p, q):
    half = lambda a, b: sum(x * log2(x / ((x + y) / 2)) for x, y in zip(a, b, strict=True) if x > 0)
    return round(sqrt(max(0.0, (half(p, q) + half(q, p)) / 2)), 6)


def classes(text):
    rules = [WHITE, "[a-z]", "[A-Z]", "[0-9]", "[#*$%&|<>]", "[\x00-\x7f]", "(?s:.)"]
    out = [0] * 7
    for c in text:
        out[next(k for k, r in enumerate(rules) if re.match(r, c))] += 1
    return out


def brute(rows):
    rows = [(d, lang if lang is not None else "und", t or "") for d, lang, t in rows]
    split = lambda t: [w for w in re.split(WHITE + "+", t) if w]
    refs = {}
    for lang in {r[1] for r in rows}:
        own = [t for _, x, t in rows if x == lang]
        w = [x for t in own for x in split(t)]
        if len(w) >= op.REFERENCE_GUARD:
            short = Counter(x.lower() for x in w if len(x) <= op.SHORT)
            common = sorted(((-n, x) for x, n in short.items() if x.isalpha()))[: op.COMMON]
            total = [sum(c) for c in zip(*map(classes, own), strict=True)]
            refs[lang] = ([x for _, x in common], [-n / len(w) for n, _ in common], [c / sum(total) for c in total])
    out = []
    for d, lang, t in rows:
        w, lines = split(t), [x for x in t.split("\n") if split(x)]
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        n = Counter(windows)
        covered = {i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)}
        failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
        chars = near = None
        if lang in refs:
            common, shares, total = refs[lang]
            if len(t) >= op.CHARS_GUARD:
                chars = distance([c / len(t) for c in classes(t)], total)
            if len(w) >= op.WORDS_GUARD:
                hits = Counter(x.lower() for x in w if len(x) <= op.SHORT)
                p = [hits[x] / len(w) for x in common]
                near = distance([*p, max(0.0, 1 - sum(p))], [*shares, 1 - sum(shares)])
        kept = not failed and not (chars or 0) > op.CHARS_MOST and not (near or 0) > op.WORDS_MOST
        out.append((d, len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), failed, kept, chars, near))
    return sorted(out, key=str)


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "a", "is"]
    return " ".join(rng.choice(common) if rng.random() < 0.4 else "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    rows = [(k, "en", prose(rng, rng.randrange(5, 300))) for k in range(120)]
    rows += [(200 + k, "en", " ".join(w.upper() + "!!" for w in prose(rng, 120).split())) for k in range(4)]
    rows += [(300 + k, "en", " | ".join(w for w in prose(rng, 250).split() if len(w) > 3)) for k in range(4)]
    same = prose(rng, 9)
    rows += [(400, "en", "\n".join([same] * 9)), (401, "en", prose(rng, 100) + "\n" + same + "\n" + prose(rng, 40) + "\r\n" + same + " x"), (402, None, prose(rng, 100)), (403, "und", prose(rng, 100)), (404, "en", None), (405, "en", ""), (406, "en", " \n\t\n"), (407, "en", "  é É Ω " * 30), (408, "xx", "a b c d e f g h " * 3), (409, "en", "x\n\nx\ny\n" + prose(rng, 30)), (None, "en", prose(rng, 90)), (1, "en", prose(rng, 90)), (410, "en", "\x1f\x00 " * 40 + prose(rng, 60))]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    got = op.rules(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    got, want = sorted(map(tuple, got.collect()), key=str), brute(rows)
    assert [r[:8] for r in got] == [r[:8] for r in want]
    for a, b in zip(got, want, strict=True):
        assert all((x is None and y is None) or abs(x - y) < 2e-6 for x, y in zip(a[8:], b[8:], strict=True)), (a, b)
    kept = {r[0]: r[7] for r in got}
    assert not any(kept[k] for k in (200, 201, 202, 203, 300, 301, 302, 303, 400))
    assert sum(not kept[k] for k in range(120) if kept[k] is not None and len(rows[k][2].split()) >= 20) <= 2


def test_labelled_junk_goes_and_clean_documents_stay(spark):
    at = "/root/testdata/sf0.1"
    got = op.op12_quality_rules(spark, at).join(spark.read.parquet(f"{at}/labels.parquet"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.filter("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert n[1, False] <= 0.01 * n[1, True] and n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0))


def test_no_python_in_the_plan(spark):
    import contextlib
    import io

    with contextlib.redirect_stdout(io.StringIO()) as shown:
        op.op12_quality_rules(spark, "/root/testdata/sf0.001").explain()
    assert "Arrow" not in shown.getvalue() and "Python" not in shown.getvalue()


def test_empty_table_and_clashing_columns(spark):
    assert op.rules(spark.createDataFrame([], "doc_id long, lang string, text string")).count() == 0
    clash = spark.createDataFrame([(1, "en", "a b", 1, 2, 3, 4)], "doc_id long, lang string, text string, words int, chars int, n int, common int")
    assert op.rules(clash).select("n_words").first()[0] == 2
