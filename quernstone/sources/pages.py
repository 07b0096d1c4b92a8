"""The main content of pages, told by shallow features of their text blocks.

A page is cut into blocks at its block-level tags, whatever their nesting and whether or not they
are closed. A block is content by its number of words and its share of linked ones, and by those
of the blocks before and after it: the decision tree that Kohlschuetter, Fankhauser and Nejdl
published (Boilerplate Detection using Shallow Text Features, 2010). Rows of tables stay together,
cells parted by bars, and a heading stays if content follows it. All of it is expressions over a
page's own row.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.text import ASIDE, HIDDEN

#: Tags that part no words.
INLINE = ("abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "del", "dfn", "em", "font", "i", "img", "input", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
#: Tags whose content is no aside whatever was left open before.
MAIN = ("article", "body", "main")
WHITE = "[ \\t\\x0B\\f\\r\\x{A0}]+"
#: Of the published tree: shares of linked words, and numbers of words.
LINKED, BEFORE_LINKED = 1 / 3, 5 / 9
FEW, NEXT_FEW, LONE, AFTER_LINKS, NEXT_AFTER_LINKS = 16, 15, 4, 40, 17

#: Marks in a page's text: link begins and ends, cell, heading, aside begins and ends, before
#: either of which the page is parted.
LINK, UNLINK, CELL, HEADING, OFF, ON, PART = "\x01", "\x02", "\x03", "\x04", "\x05", "\x06", "\x07"
MARKS = "\\x01-\\x07"


def tag(names: str, close: str, inside: str) -> str:
    return f"(?is)<{close}(?:{names})(?:[ \\t/]{inside})?>"


def steps(inside: str) -> list[tuple[str, str]]:
    """(pattern, what it becomes), one after another. inside: what a tag can hold after its name;
    quoted values may hold a >."""
    out = [(f"[{MARKS}\\n\\r]", " "), ("(?s)<!--.*?(?:-->|$)", " ")]
    out += [(f"(?is)<{t}(?:[ \\t/]{inside})?>.*?(?:</{t}[ \\t]*>|$)", " ") for t in HIDDEN]
    asides, mains = "|".join(ASIDE), "|".join(MAIN)
    out += [(tag("a", "", inside), LINK), (tag("a", "/", inside), UNLINK), (tag("|".join(INLINE), "/?", inside), "")]
    out += [(tag("td|th", "", inside), CELL), (tag("td|th", "/", inside), " "), (tag("h[1-6]", "", inside), f"\n{HEADING}")]
    out += [(tag(asides, "", inside), f"{PART}{OFF}\n"), (tag(asides, "/", inside), f"{PART}{ON}\n"), (tag(mains, "", inside), f"{PART}{ON}\n")]
    return [*out, (f"(?is)<[a-z/!?]{inside}>", "\n")]


#: What a tag can hold, without going back over it.
INSIDE = "(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+"


def decoded(text: Column) -> Column:
    """Named and numbered entities as characters; what is none stays."""
    names = F.create_map(*(x for k, v in sorted(name2codepoint.items()) for x in (F.lit(k), F.lit(chr(v)))))
    body = lambda p: F.regexp_extract(p, "^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]*);", 1)
    number = lambda e: F.when(e.rlike("^#[xX]"), F.conv(F.substring(e, 3, 6), 16, 10)).when(e.startswith("#"), F.substring(e, 2, 7)).cast("int")
    # 64 bits of UTF-32 make a character of any plane
    valid = lambda n: (n >= 32) & (n <= 0x10FFFF) & ~n.between(0xD800, 0xDFFF)
    char = lambda e: F.when(valid(number(e)), F.decode(F.unhex(F.lpad(F.hex(number(e).cast("long")), 8, "0")), "UTF-32")).otherwise(F.try_element_at(names, e))
    each = lambda p: F.when(body(p) != "", F.concat(F.coalesce(char(body(p)), F.concat(F.lit("&"), body(p), F.lit(";"))), F.substring(p, F.length(body(p)) + 2, F.length(p)))).otherwise(F.concat(F.lit("&"), p))
    parts = F.split(text, "&")
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), each), ""))


def _words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, WHITE), lambda w: w != ""))


def blocks(pages: DataFrame) -> DataFrame:
    """pages with html. Adds blocks: (text, words, linked, heading, row, aside, content) of each
    block with any word, in the page's order."""
    out = pages.withColumn("cut", F.coalesce("html", F.lit("")))
    for pattern, mark in steps(INSIDE):
        out = out.withColumn("cut", F.regexp_replace("cut", pattern, mark))
    # an aside goes on to the next mark of either kind
    parts = F.split("cut", PART)
    lines = F.flatten(F.transform(parts, lambda p: F.transform(F.split(p, "\n"), lambda x: F.struct(F.startswith(p, F.lit(OFF)).alias("aside"), x.alias("line")))))
    out = out.withColumn("lines", F.filter(lines, lambda x: x["line"].rlike(f"[^{MARKS} \\t\\x0B\\f\\r]")))
    linked = lambda x: F.array_join(F.regexp_extract_all(x, F.lit(f"{LINK}([^{LINK}{UNLINK}]*)"), 1), " ")
    cells = lambda x: F.array_join(F.filter(F.transform(F.split(x, CELL), lambda c: F.btrim(F.regexp_replace(c, f"[{MARKS}]", ""))), lambda c: c != ""), " | ")
    bare = lambda x: F.when(x.contains(CELL), cells(x)).otherwise(F.regexp_replace(x, f"[{MARKS}]", ""))
    clean = lambda x: F.btrim(F.regexp_replace(decoded(x), WHITE, " "))
    told = F.transform("lines", lambda x: F.struct(clean(bare(x["line"])).alias("text"), _words(F.regexp_replace(x["line"], f"[{MARKS}]", " ")).alias("words"), _words(linked(x["line"])).alias("linked"), x["line"].startswith(HEADING).alias("heading"), x["line"].contains(CELL).alias("row"), x["aside"].alias("aside")))
    out = out.withColumn("told", F.filter(told, lambda b: b["text"] != ""))
    share = lambda b: F.coalesce(F.try_divide(b["linked"], b["words"]), F.lit(0.0))
    count = lambda b: F.coalesce(b["words"], F.lit(0))

    def content(b: Column, i: Column) -> Column:
        before, after = F.get("told", i - 1), F.get("told", i + 1)
        plain = (count(b) > FEW) | (count(after) > NEXT_FEW) | (count(before) > LONE)
        links = (count(b) > AFTER_LINKS) | (count(after) > NEXT_AFTER_LINKS)
        own = F.when(share(before) <= BEFORE_LINKED, plain).otherwise(links) | b["row"]
        return ~b["aside"] & (share(b) <= LINKED) & own

    out = out.withColumn("flags", F.transform("told", content))
    keep = lambda b, i: F.get("flags", i) | (b["heading"] & ~b["aside"] & F.coalesce(F.get("flags", i + 1), F.lit(False)))
    both = F.transform("told", lambda b, i: F.struct(*(b[c].alias(c) for c in ("text", "words", "linked", "heading", "row", "aside")), keep(b, i).alias("content")))
    return out.withColumn("blocks", both).drop("cut", "lines", "told", "flags")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, html. page_id, url, text (content's blocks as lines; null if there are none)
    and error."""
    told = blocks(pages.select("page_id", "url", "html"))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: b["content"]), lambda b: b["text"]), "\n")
    out = told.select("page_id", "url", text.alias("text"))
    empty = F.col("text") == ""
    return out.withColumn("error", F.when(empty, F.lit("no content found"))).withColumn("text", F.when(~empty, F.col("text")))
