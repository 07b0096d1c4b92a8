import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from quernstone.llm import quality, sparse, toxicity

SF = "/root/testdata/sf0.1"


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    p = label > 0
    return (rank[p].sum() - p.sum() * (p.sum() - 1) / 2) / (p.sum() * (~p).sum())


def held(d):
    return zlib.crc32(str(d).encode()) % 5 == 0


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = dict(zip(*pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", "quality"]).to_pydict().values()))
    got = quality.quality(docs, labels).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == held(r.doc_id) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    rows = [(r.score, known[r.doc_id]) for r in got if r.held_out and r.doc_id in known]
    assert auc(*map(np.array, zip(*rows))) > 0.97


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = dict(zip(*pq.read_table(f"{SF}/labels.parquet", columns=["doc_id", "toxic"]).to_pydict().values()))
    model = toxicity.train(docs, labels.filter(~quality.held_out()), labels.toxic)
    got = toxicity.toxicity(docs, model).collect()
    rows = [(r.toxic, known[r.doc_id]) for r in got if held(r.doc_id) and r.doc_id in known]
    caught = [t for t, y in rows if y]
    clean = [t for t, y in rows if not y]
    assert sum(caught) >= 0.9 * len(caught) and sum(clean) <= 0.02 * len(clean)
    kept = {r.doc_id for r in toxicity.reject_toxic(docs, model).select("doc_id").collect()}
    assert kept == {r.doc_id for r in got if not r.toxic}


@pytest.mark.parametrize("texts", [[], [None, "", " \n", "!!", "a word", "x" * 200000, "a word"]])
def test_edges_without_labels(spark, docs_of, texts):
    docs = docs_of(texts) if texts else docs_of([]).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    q = quality.quality(docs, labels).collect()
    t = toxicity.toxicity(docs, toxicity.train(docs, labels, labels.toxic)).collect()
    assert len(q) == len(t) == len(texts)
    assert all(r.score == 0.5 for r in q) and not any(r.toxic for r in t)


def test_labels_with_nulls_repeats_and_strangers(spark, docs_of):
    docs = docs_of([(i, "good fine text" if i % 2 else "bad awful junk") for i in range(40)] + [(None, "good"), (1, "good fine text")])
    labels = spark.createDataFrame([(i, i % 2, None) for i in range(40)] + [(1, 1, 1), (999, 0, 0), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    got = {(r.doc_id, r.score > 0.5) for r in quality.quality(docs, labels).collect()}
    assert all(high == bool(d % 2) for d, high in got if d is not None)


def test_ordinal_keeps_order_and_shares_weights():
    rng, rows = random.Random(4), []
    for _ in range(1500):
        y = rng.randrange(4)
        at = np.array(sorted({rng.randrange(50, 400) for _ in range(20)} | set(range(y * 3))))
        rows.append((y, at, np.ones(len(at))))
    w, t = toxicity.fit(rows, 4)
    assert (np.diff(t) > 0).all()
    level = [float(w[: y * 3].sum()) for y in range(4)]
    assert level == sorted(level) and level[1] < t[1] < level[3]
    p = [np.diff([0, *toxicity.logistic(t - x), 1]) @ np.arange(4) for x in level]
    assert all(abs(a - b) < 0.5 for a, b in zip(p, range(4)))


def test_ordinal_gradient():
    t = np.array([0.3, 1.1])
    f = lambda eta, y: -np.log((toxicity.logistic(t[y] - eta) if y < 2 else 1) - (toxicity.logistic(t[y - 1] - eta) if y else 0))
    for y in range(3):
        high = toxicity.logistic(t[y] - 0.7) if y < 2 else 1.0
        low = toxicity.logistic(t[y - 1] - 0.7) if y else 0.0
        assert abs((f(0.7001, y) - f(0.6999, y)) / 0.0002 - (1 - high - low)) < 1e-4


def test_no_gram_crosses_rows():
    data = np.frombuffer(b"one twothree", np.uint8)
    apart = quality.grams(data, np.array([0, 7, 12]))
    first = quality.grams(data[:7], np.array([0, 7]))
    assert sorted(apart[1][apart[0] == 0]) == sorted(first[1])
    assert len(sparse.Tokens(data, np.array([0, 7, 12])).s) == 3


def test_no_label_value_is_left_out(spark):
    labels = spark.createDataFrame([(i, i % 20) for i in range(60)], "doc_id long, grade int")
    assert sorted(r.value for r in sparse.sample(labels, labels.grade, 2, 20).collect()) == sorted([*range(20)] * 2)
    with pytest.raises(ValueError, match="16"):
        sparse.sample(labels, labels.grade, 2)


def plain_ftrl(rows, shares, epochs=3, alpha=0.5, beta=1.0, l1=0.02, l2=0.01):
    """The updates one coordinate at a time, with dictionaries."""
    z, n, bias, slope, rng = {}, {}, 0.0, 1.0, np.random.default_rng(11)

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - (l1 if z[i] > 0 else -l1)) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, at, x = rows[k]
            w = {int(i): weight(int(i)) for i in at}
            s = sum(w[int(i)] * v for i, v in zip(at, x)) + bias
            g = (1 / (1 + np.exp(-s)) - (y > 0)) * shares.get(y, 1.0)
            for i, v in zip(at, x):
                i, d = int(i), g * v
                z[i] = z.get(i, 0.0) + d - ((n.get(i, 0.0) + d * d) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w[i]
                n[i] = n.get(i, 0.0) + d * d
            slope += g * g
            bias -= 0.3 * g / slope**0.5
    return {i: weight(i) for i in z}, bias


def sparse_rows(grades, count=200):
    rng, rows = random.Random(3), []
    for _ in range(count):
        y = rng.randrange(grades)
        at = np.array(sorted({rng.randrange(60) for _ in range(8)} | {100 + y}))
        rows.append((y, at, np.array([rng.random() + 0.1 for _ in at])))
    return rows


def test_ftrl_against_a_plain_loop():
    rows = sparse_rows(2)
    w, bias = quality.fit(rows, {0: 1.0, 1: 0.5})
    want, b = plain_ftrl(rows, {0: 1.0, 1: 0.5})
    assert abs(bias - b) < 1e-9 and all(abs(w[i] - v) < 1e-6 for i, v in want.items()) and (w != 0).sum() == sum(v != 0 for v in want.values())


def test_ordinal_against_a_plain_loop():
    """One epoch of a model without L1, a coordinate at a time, by numeric slopes."""
    rows, grades, alpha = sparse_rows(3, 60), 3, 1.0
    model = toxicity.Ordinal(grades, 0.0, 0.05)
    z, n, t, slopes = {}, {}, [1.0, 2.0], [1.0, 1.0]
    weight = lambda i: -z.get(i, 0.0) / ((1.0 + n.get(i, 0.0) ** 0.5) / alpha + 0.05)
    f = lambda x: 1 / (1 + np.exp(-x))
    for y, at, x in rows:
        model.learn(y, at, x)
        w = {int(i): weight(int(i)) for i in at}
        eta = sum(w[int(i)] * v for i, v in zip(at, x))
        loss = lambda eta, t: -np.log((f(t[y] - eta) if y < 2 else 1.0) - (f(t[y - 1] - eta) if y else 0.0))  # noqa: B023, E731
        h = 1e-6
        g = (loss(eta + h, t) - loss(eta - h, t)) / (2 * h)
        gt = [(loss(eta, [v + h * (j == k) for j, v in enumerate(t)]) - loss(eta, [v - h * (j == k) for j, v in enumerate(t)])) / (2 * h) for k in range(2)]
        for i, v in zip(at, x):
            i, d = int(i), g * v
            z[i] = z.get(i, 0.0) + d - ((n.get(i, 0.0) + d * d) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha * w[i]
            n[i] = n.get(i, 0.0) + d * d
        for k in range(2):
            if k in (y, y - 1):
                s = min(5.0, max(-5.0, gt[k]))
                slopes[k] += s * s
                t[k] -= s / slopes[k] ** 0.5
        t[1] = max(t[1], t[0] + 0.05)
    got = model.model.weights(slice(None))
    assert np.allclose(model.thresholds, t, atol=1e-4) and all(abs(got[i] - weight(i)) < 1e-3 for i in z)


def test_severity_rises_with_what_is_planted(spark, docs_of):
    """Held out: texts with more toxic words, as the labelled ones hold them, are more severe."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.filter("toxic IS NOT NULL")
    rows = docs.join(known.select("doc_id", "toxic"), "doc_id").select("doc_id", "text", "toxic").collect()
    seen = [{}, {}]
    for r in rows:
        if not held(r.doc_id):
            for w in set((r.text or "").lower().split()):
                seen[r.toxic > 0][w] = seen[r.toxic > 0].get(w, 0) + 1
    marks = sorted((w for w, n in seen[1].items() if n >= 8 and w not in seen[0]), key=lambda w: -seen[1][w])[:6]
    assert len(marks) >= 3
    clean = [r.text for r in rows if held(r.doc_id) and not r.toxic and len((r.text or "").split()) > 30][:40]
    made = [(100 * k + n, " ".join(t.split()[:30] + marks[: 2 * n])) for k, t in enumerate(clean) for n in range(4)]
    model = toxicity.train(docs, labels.filter(~quality.held_out()), labels.toxic)
    got = {r.doc_id: r.severity for r in toxicity.toxicity(docs_of(made), model).collect()}
    level = np.array([d % 100 for d, _ in made])
    rank = np.argsort(np.argsort([got[d] for d, _ in made]))
    assert np.corrcoef(level, rank)[0, 1] > 0.7


def test_repeated_rows_of_a_label_and_the_bound(spark, docs_of):
    docs = docs_of([(1, f"text number {i}") for i in range(500)] + [(2, "other words " * 50)])
    chosen = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, value int")
    assert len(sparse.examples(docs, chosen, quality.grams)) == 2
    assert len(sparse.examples(docs, chosen, quality.grams, 1)) == 1


def test_clashing_columns(spark, docs_of):
    docs = docs_of([(i, "good fine text" if i % 2 else "bad awful junk") for i in range(20)]).selectExpr("doc_id", "text", "1 AS value", "2 AS mark", "3 AS score", "4 AS quality")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")
    assert quality.quality(docs, labels).count() == 20
    model = toxicity.train(docs, labels, labels.toxic)
    assert toxicity.toxicity(docs, model).count() == 20 and toxicity.reject_toxic(docs, model).columns == docs.columns
