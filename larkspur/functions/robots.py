"""Robots rules as a fold over lines, in one Column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.urls import ascii_lower

#: Fixed sizes, in bytes, of the line, field and value buffers whose contents count.
LINE, FIELD, VALUE = 1023, 255, 767


def bytewise(text: Column) -> Column:
    """The UTF-8 bytes of a text as its characters, so that lengths and cuts are those of bytes."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def robots_allowed(path: Column, body: Column, agent: Column) -> Column:
    """Whether `path` may be fetched by `agent` under the robots file `body`.

    Each User-agent line opens a group of its own (the last of a stack counts); `*` and named groups merge. The
    longest matching prefix decides, Allow on equal length; no match allows. Values keep a trailing blank or
    carriage return, fields one before the colon: such lines match nothing. All lengths are of bytes, and a line, field or
    value that is too long counts as far as its buffer goes, be that in the midst of a character. Null path or body allows.
    """
    path, body, agent = bytewise(path), bytewise(body), bytewise(agent)
    who = F.when(F.coalesce(agent, F.lit("")) == "", F.lit("*")).otherwise(agent)
    start = F.struct(F.lit(False).alias("active"), F.lit(True).alias("allowed"), F.lit(-1).alias("size"))

    def step(s: Column, raw: Column) -> Column:
        line = F.substring_index(F.substring(raw, 1, LINE), "#", 1)
        shape = rf"^[ \t\x0B\f\r]*([^: \t\x0B\f\r][^:]{{0,{FIELD - 1}}}):[ \t\x0B\f\r]*([^ \t\x0B\f\r].{{0,{VALUE - 1}}})"
        shape = "(?s)" + shape
        field = ascii_lower(F.regexp_extract(line, shape, 1))
        value = F.regexp_extract(line, shape, 2)
        is_agent = field == "user-agent"
        match = (ascii_lower(value) == ascii_lower(who)) | (value == "*")
        hit = s["active"] & path.startswith(value) & (value != "")
        size = F.length(value)
        allow = hit & (field == "allow") & (size >= s["size"])
        deny = hit & (field == "disallow") & (size > s["size"])
        return F.struct(
            F.when(is_agent, match).otherwise(s["active"]).alias("active"),
            F.when(allow, F.lit(True)).when(deny, F.lit(False)).otherwise(s["allowed"]).alias("allowed"),
            F.when(allow | deny, size).otherwise(s["size"]).alias("size"),
        )

    return F.when(path.isNull() | body.isNull(), F.lit(True)).otherwise(F.aggregate(F.split(body, "\n"), start, step, lambda s: s["allowed"]))
