import numpy as np
import xxhash

from quernstone.llm import simhash


def brute(rows):
    def fp(text):
        w = (text or "").encode().lower().split()
        grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    label = list(range(len(rows)))
    again = True
    while again:
        again = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= 2 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    again = True
    least = {}
    for (d, _), k in zip(rows, label):
        if d is not None:
            least[k] = min(d, least.get(k, d))
    return sorted(((d, f"{f:016x}", least.get(k)) for (d, _), f, k in zip(rows, fps, label)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_against_brute_force(docs_of, small):
    rows = small + [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "One two"), (13, "again the same id"), (905, "x " * 3000)]
    assert got(simhash.near_duplicates(docs_of(rows))) == brute(rows)


def test_heavy_buckets_and_ties(docs_of):
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi".split()
    rows = [(i, " ".join(base * 12 + [f"w{i % 23}"])) for i in range(60)] + [(3, "lone text here"), (None, "no id at all")]
    assert got(simhash.near_duplicates(docs_of(rows), bucket=2)) == brute(rows)


def test_empty_table_and_extra_columns(docs_of, spark):
    assert simhash.near_duplicates(docs_of([]).limit(0)).count() == 0
    clash = docs_of(["a b c d"]).selectExpr("doc_id", "text", "1 AS fp", "2 AS uid", "3 AS component_id")
    assert simhash.near_duplicates(clash).columns == ["doc_id", "fingerprint", "component_id"]


def test_index_finds_all_within_two_bits():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    v = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for c in centre]))
    index = simhash.GrayIndex(v)
    q, at = index.near(v, 2)
    pairs = {(int(v[a]), int(index.values[b])) for a, b in zip(q, at)}
    assert pairs == {(int(a), int(b)) for a in v for b in v if (int(a) ^ int(b)).bit_count() <= 2}


def test_one_row_of_each_group_stays(docs_of, small):
    rows = small + [(13, "again the same id"), (900, small[5][1]), (5, small[5][1]), (901, ""), (902, None), (None, "no id")]
    kept = simhash.representatives(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    groups = len({c for _, _, c in brute([(k, t) for k, (_, t) in enumerate(rows)])})
    out = kept.select("doc_id", "text").collect()
    assert len(out) == groups
    assert (900, small[5][1]) not in {tuple(r) for r in out} and sum(r.doc_id == 5 for r in out) <= 1
