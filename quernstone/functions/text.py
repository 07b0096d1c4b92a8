"""Columns over text: tokens, windows, lines, markup."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.catalog import STRIDE, WINDOW

#: The six ASCII characters that part tokens; others, such as no-break spaces, stay inside.
WHITE = "[ \\t\\n\\x0B\\f\\r]+"


def tokens(text: Column) -> Column:
    """Tokens of a text, as they are: no stemming, stop words or marks taken off."""
    return F.filter(F.split(text, WHITE), lambda x: x != "")


def window_count(n: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """Windows of n tokens: the last one ends with the text; none without tokens."""
    more = F.ceil(F.greatest(n - window, F.lit(0)) / stride)
    return F.when(n > 0, 1 + more).otherwise(0).cast("int")


def windows(tokens: Column, window: int = WINDOW, stride: int = STRIDE) -> Column:
    """Array of (chunk_idx, token_start, token_end, tokens), overlapping by window - stride."""
    n = F.size(tokens)
    last = window_count(n, window, stride) - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(
        places,
        lambda i: F.struct(
            i.alias("chunk_idx"),
            (i * stride).alias("token_start"),
            F.least(i * stride + window, n).alias("token_end"),
            F.slice(tokens, i * stride + 1, F.lit(window)).alias("tokens"),
        ),
    )


#: What ends a line, and what is white space, in Unicode: of the classes of bytes below 0x20, of
#: NEL, and of the separators.
BREAKS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
END = f"\\r\\n|[{BREAKS}]"


def stripped(x: Column) -> Column:
    """Without white space at either end, no-break spaces too."""
    return F.btrim(x, F.lit(SPACES))


def lines(text: Column) -> Column:
    """Lines without their ends; a last end makes no further line."""
    return F.split(F.regexp_replace(text, f"({END})$(?!\n)", ""), END)


def routed(path: Column) -> Column:
    """Which reader a path needs; null if there is none."""
    low = F.lower(path)
    return (
        F.when(path.rlike("^https?://"), "url")
        .when(low.rlike("\\.pdf$"), "pdf")
        .when(low.rlike("\\.docx$"), "docx")
        .when(low.rlike("\\.(txt|text)$"), "txt")
    )


#: Parts of a page that are not its content, each with all that it holds.
HIDDEN = ("script", "style", "noscript", "template", "svg")
ASIDE = ("nav", "header", "footer", "aside", "form")


def plain(html: Column) -> Column:
    """Readable text of a page: scripts, styles, comments, what stands around the content
    (navigation, headers, footers, asides, forms) and tags go, tables stay; the five entities of
    XML and no-break spaces are decoded, runs of white space become one space."""
    x = F.regexp_replace(html, "(?s)<!--.*?-->", " ")
    for tag in (*HIDDEN, *ASIDE):
        x = F.regexp_replace(x, f"(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>", " ")
    x = F.regexp_replace(x, "(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(x, "[ \\t\\n\\x0B\\f\\r]+", " "))
