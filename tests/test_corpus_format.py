import sys
import types

from test_sources_stream import docx

from quernstone.sources import corpus_format as C

LONG = "word " * 60


def test_a_mixed_folder_in_one_read(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    at = tmp_path / "in"
    (at / "a.TXT").write_bytes(b"caf\xc3\xa9 \xff " + LONG.encode())
    (at / "deep" / "b.docx").write_bytes(docx([LONG, "last"], [["x", "y"]]))
    (at / "c.docx").write_bytes(b"broken")
    (at / "d.xyz").write_bytes(b"?")
    (at / "short.text").write_text("three words only")
    (at / "empty.txt").write_text("")
    (at / "e.pdf").write_bytes(b"no pdf")
    for k in range(30):
        (at / f"many{k:02d}.txt").write_text(f"{LONG} {k}")
    got = {r.path.split("/in/")[1]: r for r in C.read_corpus(spark, str(at), bytes=2000).collect()}
    assert len(got) == 37 and all((r.text is None) != (r.error is None) for r in got.values())
    assert got["a.TXT"].text.startswith("café  word") and got["deep/b.docx"].text.endswith("last\nx | y")
    assert got["short.text"].error == "3 words, fewer than 50" and got["empty.txt"].error.startswith("0 words")
    assert "zip" in got["c.docx"].error.lower() and "unsupported" in got["d.xyz"].error and got["e.pdf"].error
    assert sum(r.error is None for r in got.values()) == 32
    assert spark.read.format(C.FORMAT).option("bytes", 2000).load(str(at)).rdd.getNumPartitions() > 4
    assert spark.read.format(C.FORMAT).load(str(at)).rdd.getNumPartitions() == 1
    assert spark.read.format(C.FORMAT).load(f"file://{at}/a.TXT").count() == 1


def test_an_empty_folder(spark, tmp_path):
    assert C.read_corpus(spark, str(tmp_path)).count() == 0


def test_a_long_pdf_is_several_partitions(tmp_path, monkeypatch):
    class Pdf:
        def __init__(self, data):
            self.pages = [types.SimpleNamespace(extract_text=lambda k=k: f"page {k}" if k != 3 else None) for k in range(10)]

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda f: Pdf(f.read())))
    (tmp_path / "long.pdf").write_bytes(b"x" * 1000)
    (tmp_path / "small.pdf").write_bytes(b"x" * 10)
    reader = C.CorpusReader({"path": str(tmp_path), "pdfBytes": "300"})
    shares = reader.partitions()
    assert sorted(len(s.files) for s in shares) == [1] * 5
    rows = [r for s in shares for r in reader.read(s)]
    long = sorted((r for r in rows if r[0].endswith("long.pdf")), key=lambda r: r[2])
    whole = "".join(f"page {k}\n" for k in range(10) if k != 3)
    assert len(long) == 4 and "".join(r[3] for r in long) == whole
    assert [r[3] for r in rows if r[0].endswith("small.pdf")] == [whole]
