import random

import numpy as np

import corpus_pipeline
from quernstone.llm import jaccard, simhash


def brute(rows, width=5, similarity=0.8):
    """Places of the rows that stay."""

    def grams(text):
        w = (text or "").encode().lower().split()
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())

    sets = [grams(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 10 >= len(a | b) * round(10 * similarity):
                label[max(root(i), root(j))] = min(root(i), root(j))
    found = {}
    for k, (d, _) in enumerate(rows):
        found.setdefault(root(k), []).append((d is not None, d or 0, k))
    return sorted((rows[min(x)[2]] for x in found.values()), key=str)


def varied(seed=3):
    """Texts with 0 to 12 of 120 words changed, apart and side by side, and short ones."""
    rng = random.Random(seed)
    out = []
    for k in range(12):
        base = [f"w{rng.randrange(5000)}" for _ in range(120)]
        for c in range(13):
            t = list(base)
            for x in range(c):
                t[(x * 9 + k) % 120 if c % 2 else 40 + x] = f"z{rng.randrange(9999)}"
            out.append(" ".join(t))
    return [*out, "one", "One", "one two", "a b c d e", "A b c d e f", "", " \n", "x " * 300]


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def test_against_brute_force(docs_of, small):
    rows = [*small, *((1000 + i, t) for i, t in enumerate(varied())), (None, "no id at all"), (13, "again"), (2000, None)]
    assert kept(jaccard.representatives(docs_of(rows))) == brute(rows)
    rows = rows[-80:]
    assert kept(jaccard.representatives(docs_of(rows), crowd=4)) == brute(rows)
    assert kept(jaccard.representatives(docs_of(rows), most=500)) == brute(rows)


def test_pipeline_stage_drops_near_copies(docs_of, spark):
    words = [f"word{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:50], "other", *words[51:]])), (3, " ".join([*words[:30], *(f"q{i}" for i in range(70))]))]
    assert [d for d, _ in kept(corpus_pipeline.drop_near_duplicates(spark, docs_of(rows), ""))] == [1, 3]


def test_a_crowded_key_is_listed_in_parts(spark):
    sets = spark.createDataFrame([(m, 10 + m % 3, [7, *([8] if m < 3 else [])]) for m in range(40)], "mark long, n long, keys array<long>")
    lists = [{r.mark for r in x.met} for x in jaccard._companies(sets, 12).collect()]
    together = {(a, b) for x in lists for a in x for b in x if a < b}
    assert len(together) == 40 * 39 // 2 and max(map(len, lists)) <= 24


def test_empty_table_and_clashing_columns(docs_of):
    assert jaccard.representatives(docs_of([]).limit(0)).count() == 0
    names = ["uid", "mark", "keys", "n", "row", "least", "root"]
    clash = docs_of(["a b c", "a b c", None, ""]).selectExpr("doc_id", "text", *(f"'x' AS {c}" for c in names))
    out = jaccard.representatives(clash)
    assert out.columns == clash.columns and sorted(r.doc_id for r in out.collect()) == [0, 2]


def test_fingerprints_bring_similar_sets_together(spark):
    """Links come from the SimHash index alone, are exact, and spare the prefix filter's meetings."""
    rng = random.Random(4)
    sets = [[rng.getrandbits(62) for _ in range(100)] for _ in range(6)]
    rows = [(10 * k + c, 100, sorted([*s[c:], *(7 * k + c + x for x in range(c))]), [k, 99], 1 << 9 * k if c < 3 else -1 - k) for k, s in enumerate(sets) for c in range(4)]
    rows.append((1000, 100, sorted(rng.getrandbits(62) for _ in range(100)), [0], 3))  # a fingerprint nearby, another set
    df = spark.createDataFrame([(m, n, keys, bytearray(np.array(g, np.uint64).tobytes()), fp) for m, n, g, keys, fp in rows], "mark long, n long, keys array<long>, shingles binary, fp long")
    near = jaccard.connected_components(jaccard.near_links(df, radius=1))
    found = {r.node: r.root for r in near.collect()}
    assert 1000 not in found and {m // 10 for m in found} == set(range(6))
    assert all(len({found[10 * k + c] for c in range(3)}) == 1 for k in range(6))
    known = near.select("node", "root")
    keyed = df.filter("mark < 1000 AND mark % 10 < 3").withColumn("keys", jaccard.F.slice("keys", 1, 1))
    assert jaccard.links(keyed, known=known).count() == 0 < jaccard.links(keyed).count()


def test_index_follows_the_radius(spark):
    rng = random.Random(6)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), k % 7)) for k, v in enumerate(values)]
    values = sorted(set(values))
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    for bits in (0, 2, 4, 5):
        want = {(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= bits}
        for bucket in (20_000, 0):
            roots = {r.node: r.root for r in simhash.connected_components(simhash.links(df, bucket, bits)).collect()}
            own = lambda v: roots.get(v - (1 << 64) if v >> 63 else v, v)  # noqa: E731, B023
            assert {(a, b) for i, a in enumerate(values) for b in values[:i] if own(a) == own(b)} == want
