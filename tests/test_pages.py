import pytest
from pyspark.sql import functions as F

from quernstone.operators import index as I
from quernstone.operators.prefix import before
from quernstone.sources import documents as D
from quernstone.sources import pages as M

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
LINKS = "<ul>" + "".join(f"<li><a href='/{k}'>go to place {k}</a>" for k in range(5)) + "</ul>"


def text(spark, html):
    return M.main_text(spark.createDataFrame([(1, "u", html)], "page_id int, url string, html string")).first()


@pytest.mark.parametrize(
    "html,want",
    [
        (f"<nav>{LINKS}</nav><h1>Title</h1><p>{LONG}</p><footer>Imprint {LONG}</footer>", f"Title\n{LONG}"),
        # an aside that is never closed ends where the content begins
        (f"<body><header><nav>{LINKS}<article><p>{LONG}</p><p>{LONG}</p></article>", f"{LONG}\n{LONG}"),
        # nested ones, and links without an aside around them
        (f"<header>{LINKS}<nav>x</nav></header>{LINKS}<div><div><p>{LONG}<p>{LONG} more</div>", f"{LONG}\n{LONG} more"),
        (f"<p>{LONG}</p><table><tr><th>Name<th>Year</tr><tr><td>A &amp; B</td><td>1999</td></tr></table>", f"{LONG}\nName | Year\nA & B | 1999"),
        (f"<p>{LONG} &eacute;&#233;&#xE9; &lt;b&gt; &nosuch; & &#128512; &amp;amp;</p>", f"{LONG} ééé <b> &nosuch; & 😀 &amp;"),
        (f"<script>var t = '</p>{LONG}'</script><!-- {LONG} --><p title='a > b'>{LONG}<b>x</b>y", f"{LONG}xy"),
        (f"<P>{LONG}</P><SCRIPT>never closed {LONG}", LONG),
        (f"<p>{LONG}<!-- never closed {LONG}", LONG),
        (f"<p>{LONG} \t\n end", f"{LONG} end"),
    ],
)
def test_content(spark, html, want):
    assert text(spark, html).text == want


@pytest.mark.parametrize("html", [None, "", "   ", LINKS, f"<nav>{LONG}</nav>", "<p>short</p>"])
def test_nothing_but_links_asides_or_scraps(spark, html):
    r = text(spark, html)
    assert r.text is None and r.error == "no content found"


def test_long_and_broken_markup_ends(spark):
    for html in ("<p " + "a='x' " * 20000 + f">{LONG}", "<div>" * 20000 + LONG, f"{LONG}<p title=\"{'x' * 100000}", "<" * 50000 + LONG, "&" * 50000 + LONG):
        assert text(spark, html) is not None


def rows(spark, n):
    return spark.createDataFrame([("big" if k % 9 else None if k % 2 else "small", (k * 37) % 1000, k % 5) for k in range(n)], "corpus_id string, doc_id int, n int")


def test_sums_before_a_row(spark):
    df = rows(spark, 1000).repartition(7)
    got = {(r.corpus_id, r.doc_id): r.before for r in before(df, ["corpus_id"], ["doc_id"], F.col("n")).collect()}
    own = [tuple(r) for r in df.collect()]
    assert got == {(c, d): sum(n for x, e, n in own if x == c and e < d) for c, d, _ in own}


def test_a_corpus_is_numbered_in_ranges(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = rows(spark, 1000).select(F.lit("one").alias("corpus_id"), "doc_id", F.lit("a b").alias("text"))
        got = I.numbered(I.chunk(docs))
        assert [r.chunk_id for r in got.orderBy("doc_id").collect()] == list(range(1000))
        numbered = D.numbered(docs.withColumn("path", F.format_string("%05d", "doc_id")), "path")
        assert [r.doc_id for r in numbered.orderBy("path").collect()] == list(range(1000))
        tasks = before(docs, ["corpus_id"], ["doc_id"], F.lit(1)).select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
