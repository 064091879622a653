"""Tokens, whitespace, HTML and segments as Column expressions: all of it stays in generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.binding import let

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the two token profiles: bytes kept of an ASCII token, tokens kept of a document and of a query.
TOKEN_BYTES, DOC_TOKENS, QUERY_TOKENS = 127, 1024, 128
MOST_LINKS = 2048
SPACES = r"[ \t\n\x0B\f\r]+"


def until_nul(text: Column) -> Column:
    """Text ends at its first NUL."""
    return F.substring_index(text, "\0", 1)


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, cut at TOKEN_BYTES, lower-cased. Found before they are lower-cased, since lower() can turn other characters into ASCII."""
    found = F.regexp_extract_all(until_nul(text), F.lit("[A-Za-z0-9]+"), F.lit(0))
    return F.transform(found, lambda t: F.lower(F.substring(t, 1, TOKEN_BYTES)))


def unicode_tokens(text: Column, most: int = DOC_TOKENS) -> Column:
    """Runs of ASCII letters, digits, `_`, `-` and all characters beyond ASCII; A-Z alone is lower-cased; the first `most` count."""
    found = F.regexp_extract_all(until_nul(text), F.lit(r"[A-Za-z0-9_\-\x{80}-\x{10FFFF}]+"), F.lit(0))
    return F.transform(F.slice(found, 1, most), lambda t: F.translate(t, UPPER, LOWER))


def occurrences(tokens: Column, term: Column) -> Column:
    return F.size(F.filter(tokens, lambda t: t == term))


def collapsed(text: Column) -> Column:
    """Runs of C-locale whitespace become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text, SPACES, " "))


def without_tags(html: Column) -> Column:
    """Everything between `<` and `>` becomes a blank, a stray `>` too; an unclosed `<` takes the rest."""
    return F.regexp_replace(html, "<[^>]*>?|>", " ")


def decoded(text: Column) -> Column:
    """Five entities, one after the other, so that what decoding makes can be decoded again."""
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def html_title(html: Column) -> Column:
    """The first title, not decoded; empty, if there is none."""
    return collapsed(F.regexp_extract(html, r"(?i)<title\b[^>]*>([\s\S]*?)</title>", 1))


def html_text(html: Column) -> Column:
    """Visible text, title and comments' text included; scripts and styles go."""
    for name in ("script", "style"):
        html = F.regexp_replace(html, rf"(?i)<{name}\b[^>]*>[\s\S]*?</{name}>", " ")
    return collapsed(decoded(without_tags(html)))


def html_links(html: Column) -> Column:
    """Quoted href values anywhere in the page, as they stand, without those that begin with `#`; the first MOST_LINKS."""
    found = F.regexp_extract_all(html, F.lit("(?i)href[ \\t\\n\\x0B\\f\\r]*=[ \\t\\n\\x0B\\f\\r]*[\"']([^\"']+)[\"']"), F.lit(1))
    return F.slice(F.filter(found, lambda x: ~x.startswith("#")), 1, MOST_LINKS)


def content_type(headers: Column) -> Column:
    """The last Content-Type header's value, trimmed; null without one."""
    found = F.regexp_extract_all(headers, F.lit("(?im)^content-type:[ \\t]*([^\\r\\n]*)"), F.lit(1))
    return F.rtrim(F.try_element_at(found, F.lit(-1)))


def cut_bytes(text: Column, n: int) -> Column:
    """At most n bytes of UTF-8, as a fixed buffer keeps them; a split last character shows as a replacement character."""
    raw = F.encode(text, "UTF-8")
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(raw, 1, n).cast("string"))


_MARK = "\x01"
#: Openers with their closers, tried in this order at each byte.
MARKED = ((r"```", r"```", "code"), (r"\$\$", r"\$\$", "latex"), (r"\\\[", r"\\\]", "latex"), (r"\\\(", r"\\\)", "latex"))


#: Segments of a text whose offsets are summed together.
BLOCK = 64


def segments(text: Column) -> Column:
    """array<struct<index int, kind string, start bigint, length bigint>>: text, code and latex spans that tile the text; offsets in bytes.

    A marked span holds its delimiters and runs to the first closer, or to the end. The control character U+0001
    separates spans on the way; where a text holds it, it is taken for a blank.
    """
    marked = "|".join(rf"{a}[\s\S]*?(?:{b}|\z)" for a, b, _ in MARKED)
    cut = F.regexp_replace(F.translate(text, _MARK, " "), f"({marked})", f"{_MARK}$1{_MARK}")
    parts = F.filter(F.split(cut, _MARK), lambda x: F.length(x) > 0)

    def kind_of(x: Column) -> Column:
        return F.when(x.startswith("```"), "code").when(x.startswith("$$") | x.startswith("\\[") | x.startswith("\\("), "latex").otherwise("text")

    sized = F.transform(parts, lambda x, i: F.struct(i.cast("int").alias("index"), kind_of(x).alias("kind"), F.octet_length(x).cast("bigint").alias("length")))

    def sums(lengths: Column) -> Column:
        """What stands before each length."""
        return F.aggregate(lengths, F.array(F.lit(0).cast("bigint")), lambda done, n: F.concat(done, F.array(F.element_at(done, -1) + n)))

    def placed(all_: Column) -> Column:
        # A fold copies what it has at each step: sums run over blocks, and over the blocks' lengths.
        block = lambda b: F.slice(all_, b * BLOCK + 1, BLOCK)
        blocks = F.sequence(F.lit(0), F.greatest((F.size(all_) - 1) / BLOCK, F.lit(0)).cast("int"))
        inner = F.transform(blocks, lambda b: sums(F.transform(block(b), lambda s: s["length"])))
        starts = sums(F.transform(inner, lambda x: F.element_at(x, -1)))

        def moved(b: Column, before: Column) -> Column:
            return F.zip_with(block(b), F.slice(before, 1, BLOCK), lambda s, x: F.when(s.isNotNull(), F.struct(s["index"].alias("index"), s["kind"].alias("kind"), (F.get(starts, b) + x).alias("start"), s["length"].alias("length"))))

        return F.filter(F.flatten(F.zip_with(blocks, inner, moved)), lambda s: s.isNotNull())

    return F.when(parts.isNotNull(), let(sized, placed))
