"""Quality rules by divergence: a document's histograms of character classes and of common words
against those of its language. DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import table, written

SPACE = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
#: Words of a window that may recur within a text.
WINDOW = 8
#: Base rules: words that a text has at least, and percent of them that recurring windows cover.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: Common words of a language: its COMMON most frequent of those of up to SHORT letters.
COMMON, SHORT = 32, 5
#: Characters and words below which a histogram says too little to judge a text by, and words
#: below which a language has no reference.
CHARS_GUARD, WORDS_GUARD, REFERENCE_GUARD = 200, 80, 5000
#: Jensen-Shannon distances (base 2, 0 to 1) above which a text is dropped.
CHARS_MOST, WORDS_MOST = 0.22, 0.32

CLASSES = ("space", "lower", "upper", "digit", "symbol", "punct", "other")


def words(text: Column) -> Column:
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda x: x != "")


def classified(docs: DataFrame) -> DataFrame:
    """docs with text and its words. Adds n_chars, word_chars, n_symbols, and chars: characters
    by class, in the order of CLASSES (ASCII ones, and all others together)."""
    out = docs.withColumn("solid", F.array_join("words", ""))
    order = ["text", "solid"]
    for chars in ("a-z", "A-Z", "0-9", SYMBOLS, "\\x00-\\x7F"):
        order.append(f"cut{len(order)}")
        out = out.withColumn(order[-1], F.regexp_replace(order[-2], f"[{chars}]+", ""))
    size = [F.length(c).cast("long") for c in order]
    counts = F.array(*(a - b for a, b in zip(size, size[1:], strict=False)), size[-1])
    out = out.withColumn("n_chars", size[0]).withColumn("word_chars", size[1]).withColumn("n_symbols", size[4] - size[5]).withColumn("chars", counts)
    return out.drop(*order[1:])


def _recurring(docs: DataFrame) -> DataFrame:
    """docs with words. Adds n_repeat_words. Windows are told apart by 64 bits within a text.
    A text without a recurring window, as most are, is not sorted."""
    out = docs.withColumn("code", F.transform("words", lambda w: F.xxhash64(w)))
    n = F.greatest(F.size("code") - (WINDOW - 1), F.lit(0))
    window = F.transform(F.slice("code", F.lit(1), n), lambda x, i: F.xxhash64(x, *(F.get("code", i + k) for k in range(1, WINDOW))))
    out = out.withColumn("window", window)
    both = F.transform("window", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    none = F.filter(both, lambda _: F.lit(False))
    out = out.withColumn("sorted", F.when(F.size(F.array_distinct("window")) < F.size("window"), F.sort_array(both)).otherwise(none))
    again = lambda x, j: F.coalesce(x["x"] == F.get("sorted", j - 1)["x"], F.lit(False)) | F.coalesce(x["x"] == F.get("sorted", j + 1)["x"], F.lit(False))
    out = out.withColumn("place", F.sort_array(F.transform(F.filter("sorted", again), lambda x: x["i"])))
    # a window covers what is left of it before the next recurring one
    covers = F.transform("place", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("place", k + 1) - p, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0).cast("long"), lambda s, x: s + x))
    return out.drop("code", "window", "sorted", "place")


def common_words(docs: DataFrame) -> DataFrame:
    """docs: lang, text (no nulls). A row for each language with enough words: common (its common
    words, most frequent first) and words_ref (their shares among its words). All documents are
    counted."""
    each = docs.select("lang", F.explode(words(F.col("text"))).alias("word"))
    counted = each.groupBy("lang", F.when(F.length("word") <= SHORT, F.lower("word")).alias("word")).agg(F.count("*").alias("n"))
    # the best of each part of a language's words, then the best of those
    best = lambda rows: F.slice(F.sort_array(F.collect_list(rows)), 1, COMMON)
    entry = F.when(F.col("word").rlike("^\\p{L}+$"), F.struct((-F.col("n")).alias("less"), "word"))
    parts = counted.groupBy("lang", F.pmod(F.xxhash64("word"), F.lit(64)).alias("part")).agg(best(entry).alias("top"), F.sum("n").alias("n"))
    top = parts.groupBy("lang").agg(F.sum("n").alias("n"), F.slice(F.sort_array(F.flatten(F.collect_list("top"))), 1, COMMON).alias("top")).filter(F.col("n") >= REFERENCE_GUARD)
    return top.select("lang", F.transform("top", lambda e: e["word"]).alias("common"), F.transform("top", lambda e: -e["less"] / F.col("n")).alias("words_ref"))


def class_shares(measured: DataFrame) -> DataFrame:
    """measured: lang, chars. chars_ref: the shares of CLASSES of each language."""
    totals = measured.groupBy("lang").agg(*(F.sum(F.col("chars")[k]).alias(c) for k, c in enumerate(CLASSES)))
    whole = sum((F.col(c) for c in CLASSES[1:]), F.col(CLASSES[0]))
    return totals.filter(whole > 0).select("lang", F.array(*(F.col(c) / whole for c in CLASSES)).alias("chars_ref"))


def js_distance(pairs: Column) -> Column:
    """The Jensen-Shannon distance of two histograms, from (p, q) of their bins."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
    each = lambda b: part(b["p"], (b["p"] + b["q"]) / 2) + part(b["q"], (b["p"] + b["q"]) / 2)
    return F.sqrt(F.greatest(F.aggregate(pairs, F.lit(0.0), lambda s, b: s + each(b)) / 2, F.lit(0.0)))


def _pair(p: Column, q: Column) -> Column:
    return F.struct(p.alias("p"), q.alias("q"))


def rules(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, lang, text): doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, kept, chars_distance, words_distance.

    Distances are from the histograms of the text's language, which all documents make up; they
    are null where a guard says that a text is too short, or its language too small, to judge it.
    A text that the base rules pass is dropped if one of its distances is too large.

    Null and empty texts have no words, so the base rules drop them; a null language is one of
    its own; repeated rows have a result each and all count for the reference; an empty table
    gives no rows; other columns, those that clash too, are ignored. A text is held as an array
    of its words, some 100 bytes each: texts of up to 50 MB fit a task of 2 GB.
    """
    own = docs.select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    refs = written(common_words(own), "languages")
    out = own.join(refs, "lang", "left").withColumn("words", words(F.col("text")))
    out = _recurring(classified(out))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    out = out.withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    out = out.withColumn("n_words", F.size("words").cast("long")).drop("lines", "text")
    # a copy of the list is a plain array, quick to look through; places of words in it, 0: another
    out = out.withColumn("listed", F.transform("common", lambda x: x))
    hits = F.filter(F.transform(F.filter("words", lambda w: F.length(w) <= SHORT), lambda w: F.array_position("listed", F.lower(w))), lambda k: k > 0)
    out = out.withColumn("hits", F.when(F.size("listed") > 0, hits).otherwise(F.array().cast("array<long>"))).drop("words", "listed")
    found = F.transform("words_ref", lambda q, k: _pair((F.size("hits") - F.size(F.array_remove("hits", (k + 1).cast("long")))) / F.col("n_words"), q))
    rest = _pair(1 - F.size("hits") / F.col("n_words"), 1 - F.aggregate("words_ref", F.lit(0.0), lambda s, q: s + q))
    known = F.col("words_ref").isNotNull()
    out = out.withColumn("words_distance", F.when(known & (F.col("n_words") >= WORDS_GUARD), F.round(js_distance(F.concat(found, F.array(rest))), 6)))
    out = out.select("doc_id", "lang", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "words_distance", known.alias("known"))
    measured = written(out, "measured")

    out = measured.join(written(class_shares(measured), "classes"), "lang", "left")
    chars = js_distance(F.zip_with("chars", "chars_ref", lambda n, q: _pair(n / F.col("n_chars"), q)))
    out = out.withColumn("chars_distance", F.when(F.col("known") & (F.col("n_chars") >= CHARS_GUARD), F.round(chars, 6)))
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    far = F.coalesce(F.col("chars_distance") > CHARS_MOST, F.lit(False)) | F.coalesce(F.col("words_distance") > WORDS_MOST, F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "chars_distance", "words_distance")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))


#: The same in DuckDB's SQL.
SQL = f"""WITH own AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents),
cut AS (SELECT *, regexp_replace(text, '[{SPACE}]+', '', 'g') AS solid FROM own),
cut1 AS (SELECT *, regexp_replace(solid, '[a-z]+', '', 'g') AS c1 FROM cut),
cut2 AS (SELECT *, regexp_replace(c1, '[A-Z]+', '', 'g') AS c2 FROM cut1),
cut3 AS (SELECT *, regexp_replace(c2, '[0-9]+', '', 'g') AS c3 FROM cut2),
cut4 AS (SELECT *, regexp_replace(c3, '[{SYMBOLS}]+', '', 'g') AS c4 FROM cut3),
cut5 AS (SELECT *, regexp_replace(c4, '[\\x00-\\x7F]+', '', 'g') AS c5 FROM cut4),
classed AS (SELECT uid, doc_id, lang, text, length(text) AS n_chars, length(solid) AS word_chars, length(c3) - length(c4) AS n_symbols,
  [length(text) - length(solid), length(solid) - length(c1), length(c1) - length(c2), length(c2) - length(c3), length(c3) - length(c4), length(c4) - length(c5), length(c5)] AS chars,
  list_filter(regexp_split_to_array(text, '[{SPACE}]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines FROM cut5),
w AS (SELECT uid, lang, unnest(words) AS word, unnest(range(len(words))) AS i FROM classed),
win AS (SELECT uid, i, string_agg(word, ' ') OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS win,
  count(*) OVER (PARTITION BY uid ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS k FROM w),
again AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, win) AS n FROM win WHERE k = {WINDOW}) WHERE n > 1),
repeated AS (SELECT uid, count(DISTINCT i + k) AS n_repeat_words FROM again, range({WINDOW}) t(k) GROUP BY ALL),
total AS (SELECT lang, sum(len(words)) AS n, sum(n_chars) AS c,
  sum(chars[1]) AS c1, sum(chars[2]) AS c2, sum(chars[3]) AS c3, sum(chars[4]) AS c4, sum(chars[5]) AS c5, sum(chars[6]) AS c6, sum(chars[7]) AS c7
  FROM classed GROUP BY lang HAVING sum(len(words)) >= {REFERENCE_GUARD}),
short AS (SELECT lang, lower(word) AS word, count(*) AS n FROM w WHERE length(word) <= {SHORT} GROUP BY ALL),
placed AS (SELECT lang, word, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM short WHERE regexp_matches(word, '^\\p{{L}}+$')),
common AS (SELECT lang, word, place, short.n / total.n AS q FROM placed AS short JOIN total USING (lang) WHERE place <= {COMMON}),
hit AS (SELECT w.uid, w.lang, common.word, count(*) AS n FROM w JOIN common ON w.lang = common.lang AND lower(w.word) = common.word GROUP BY ALL),
bins AS (SELECT d.uid, coalesce(h.n, 0) / len(d.words) AS p, c.q FROM classed d JOIN common c USING (lang) LEFT JOIN hit h ON h.uid = d.uid AND h.word = c.word WHERE len(d.words) > 0
  UNION ALL SELECT d.uid, 1 - coalesce((SELECT sum(n) FROM hit h WHERE h.uid = d.uid), 0) / len(d.words), 1 - coalesce((SELECT sum(q) FROM common c WHERE c.lang = d.lang), 0) FROM classed d JOIN total USING (lang) WHERE len(d.words) > 0),
kinds AS (SELECT d.uid, unnest(chars) / n_chars AS p, unnest([c1, c2, c3, c4, c5, c6, c7]) / c AS q FROM classed d JOIN total USING (lang) WHERE n_chars > 0),
far AS (SELECT uid, round(sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2, 0)), 6) AS far, kind
  FROM (SELECT *, 'w' AS kind FROM bins UNION ALL SELECT *, 'c' AS kind FROM kinds) GROUP BY ALL),
told AS (SELECT d.*, coalesce(r.n_repeat_words, 0) AS n_repeat_words, CASE WHEN n_chars >= {CHARS_GUARD} THEN fc.far END AS chars_distance, CASE WHEN len(words) >= {WORDS_GUARD} THEN fw.far END AS words_distance
  FROM classed d LEFT JOIN repeated r USING (uid) LEFT JOIN far fc ON fc.uid = d.uid AND fc.kind = 'c' LEFT JOIN far fw ON fw.uid = d.uid AND fw.kind = 'w'),
based AS (SELECT *, CAST(len(words) AS BIGINT) AS n_words, len(words) < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * len(words) AS base_failed FROM told)
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(chars_distance > {CHARS_MOST}, FALSE) AND NOT coalesce(words_distance > {WORDS_MOST}, FALSE) AS kept, chars_distance, words_distance FROM based"""
