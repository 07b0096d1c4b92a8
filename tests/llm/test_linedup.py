import hashlib
import math
import re
from collections import defaultdict

import pytest

from quernstone.llm import linedup as op


def brute(rows, min_docs=5, similarity=0.8, long_docs=None):
    """rows: (doc_id, text), told apart by their place."""
    odd = re.compile(r"[0-9@]|://")
    split = lambda t: [x for x in re.split(r"[ \t\x0b\x0c\r]+", t) if x]
    masked = lambda line: tuple("<*>" if odd.search(x) else x for x in split(line))

    def lines_of(t):
        parts = (t or "").split("\n")
        return parts[:-1] if parts[-1] == "" else parts

    docs = defaultdict(set)
    for k, (_, t) in enumerate(rows):
        for line in lines_of(t):
            if m := masked(line):
                docs[m].add(k)
    at = defaultdict(int)
    for m, ks in docs.items():
        for pos, tok in enumerate(m):
            at[len(m), m[:3], pos, tok] += len(ks)
    template, members = {}, defaultdict(set)
    for m, ks in docs.items():
        held = sorted(((at[len(m), m[:3], pos, tok], pos, tok) for pos, tok in enumerate(m)), reverse=True)
        least = math.ceil(similarity * len(m))
        # the share of the tokens that most documents of the leaf have, with all that tie
        if held[least - 1][0] >= min_docs:
            template[m] = (len(m), m[:3], frozenset(x for x in held if x[0] >= held[least - 1][0]))
            members[template[m]] |= ks
    order = lambda k: (rows[k][0] is None, rows[k][0] or 0, k)
    first = {t: min(ks, key=order) for t, ks in members.items() if len(ks) >= min_docs}
    alike = {m: min(ks, key=order) for m, ks in docs.items() if long_docs and len(m) > 50 and len(ks) >= long_docs}
    out = []
    for k, (d, t) in enumerate(rows):
        gone = lambda m: first.get(template.get(m), k) != k or alike.get(m, k) != k  # noqa: B023, E731
        keep = [x for x in lines_of(t) if not ((m := masked(x)) and gone(m))]
        n = len(lines_of(t))
        text = (t or "") if len(keep) == n else "\n".join(keep)
        out.append((d, n, n - len(keep), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [2, 5])
def test_against_brute_force(docs_of, small, least):
    rows = [*small, (500, None), (501, ""), (502, "\n\n"), (503, "\n")]
    rows += [(510 + i, f"Posted by user{i} on day {i}\nkeep {i * 7} this line of its own number word{'abcdefgh'[i]}\n\nread more at http://x.org/{i} now") for i in range(8)]
    rows += [(530 + i, f"the quick brown fox jumps over a lazy {'cat dog cow hen pig'.split()[i]} today again\nlast") for i in range(5)]
    rows += [(None, "last"), (530, "last"), (540, "é à\t ü\nlast\n")]
    assert got(op.line_report(docs_of(rows), least)) == brute(rows, least)


def test_texts_keep_all_columns_and_rows(docs_of):
    rows = [(i, f"Header line of all pages here\n{'x' * i}a differs wholly {'y' * i}b from {'z' * i}c others") for i in range(6)] + [(9, None), (9, "")]
    kept = op.dedup_lines(docs_of(rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert (0, rows[0][1]) in out and (3, "xxxa differs wholly yyyb from zzzc others") in out and (9, None) in out and len(out) == 8
    clash = docs_of(rows).selectExpr("doc_id", "text", "1 AS uid", "2 AS mark", "3 AS marks", "4 AS row", "5 AS leaf")
    assert op.dedup_lines(clash).columns == clash.columns and op.dedup_lines(clash).count() == 8
    assert op.dedup_lines(docs_of([]).limit(0)).count() == 0


@pytest.mark.parametrize("values", [4, 5, 9])
def test_more_documents_of_a_template_never_save_it(docs_of, values):
    rows = [(a * values + b, f"this article was written by name{'abcdefghi'[a]} and reviewed in town{'abcdefghi'[b]} before it went out") for a in range(values) for b in range(values)]
    assert sum(r.n_dropped for r in op.line_report(docs_of(rows)).collect()) == values**2 - 1


def test_long_lines_recur_from_two_documents_on(docs_of, spark):
    import corpus_pipeline

    line = lambda n, x: " ".join(f"{x}word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(n))
    rows = [(1, f"{line(60, 'p')}\n{line(50, 's')}\none"), (2, f"two\n{line(60, 'p')}\n{line(50, 's')}"), (3, line(60, "q"))]
    kept = corpus_pipeline.drop_recurring_lines(spark, docs_of(rows), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [rows[0], (2, f"two\n{line(50, 's')}"), rows[2]]


def test_empty_table_and_clashing_columns(docs_of):
    assert op.dedup_lines(docs_of([]).limit(0)).count() == 0
    names = ("uid", "row", "leaf", "mark", "marks", "tokens", "template", "least")
    clash = docs_of(["one line that comes again", None, *["one line that comes again"] * 5]).selectExpr("doc_id", "text", *(f"'x' AS {c}" for c in names))
    out = op.dedup_lines(clash, min_docs=3)
    assert out.columns == clash.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(0, "one line that comes again"), (1, None), *((i, "") for i in range(2, 7))]
