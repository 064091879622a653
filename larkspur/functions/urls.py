"""URLs as Column expressions: canonical form, resolution of references, fetch policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.binding import let
from larkspur.functions.text import LOWER, UPPER

#: Bytes of the longest canonical URL.
MOST_BYTES = 2047
_ABSOLUTE = r"(?i)^(https?)://([^/?#]+)([^#]*)"


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def canonical(url: Column, most: int = MOST_BYTES) -> Column:
    """Scheme and host lower-cased, default port and fragment gone, a bare host gets `/`; null for what is no http(s) URL or too long.

    Userinfo stays with the host; path and query keep their bytes; `http://h?x` gains no slash.
    """
    scheme = ascii_lower(F.regexp_extract(url, _ABSOLUTE, 1))
    host = ascii_lower(F.regexp_extract(url, _ABSOLUTE, 2))
    rest = F.regexp_extract(url, _ABSOLUTE, 3)
    plain = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).otherwise(F.regexp_replace(host, ":443$", ""))
    plain = F.when(host.startswith("[") & (F.length(host) >= 2), host).otherwise(plain)
    out = F.concat(scheme, F.lit("://"), plain, F.when(rest == "", F.lit("/")).otherwise(rest))
    return F.when(url.rlike(_ABSOLUTE) & (F.octet_length(out) <= most), out)


def normal_path(path: Column) -> Column:
    """Path and query with `.`, `..` and empty steps resolved; a final `..` leaves a slash behind, if anything is left."""

    def joined(steps: Column) -> Column:
        stack = F.aggregate(
            steps,
            F.array().cast("array<string>"),
            lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))),
        )
        last_up = F.coalesce(F.try_element_at(steps, F.lit(-1)) == "..", F.lit(False))
        return let(
            stack,
            lambda left: F.concat(
                F.when(path.startswith("/"), F.lit("/")).otherwise(F.lit("")),
                F.array_join(left, "/"),
                F.when(last_up & (F.size(left) > 0), F.lit("/")).otherwise(F.lit("")),
            ),
        )

    return let(F.filter(F.split(path, "/"), lambda s: (s != "") & (s != ".")), joined)


def resolved(base: Column, ref: Column, most: int = MOST_BYTES) -> Column:
    """The canonical URL that `ref` means on the page `base`; null, where there is none.

    Steps are resolved over path and query together, and a scheme other than http(s) reads as a relative path.
    """
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    authority = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    tail = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    path = F.substring_index(tail, "?", 1)
    folder = F.regexp_extract(path, r"^(.*/)", 1)
    joined = (
        F.when(ref.startswith("#"), path)
        .when(ref.startswith("?"), F.concat(path, ref))
        .when(ref.startswith("/"), ref)
        .otherwise(F.concat(folder, ref))
    )

    def whole(target: Column) -> Column:
        return let(normal_path(target), lambda normal: F.concat(scheme, F.lit("://"), authority, F.when(normal == "", F.lit("/")).otherwise(normal)))

    absolute = (
        F.when(ref.isNull() | (ref == ""), F.lit(None).cast("string"))
        .when(ref.rlike("(?i)^https?://"), ref)
        .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
        .otherwise(let(F.substring_index(joined, "#", 1), whole))
    )
    return let(absolute, lambda url: canonical(url, most))


def may_fetch(url: Column) -> Column:
    """Whether policy allows a fetch: lower-case http(s), an authority without userinfo, and not the local machine or its metadata service."""
    authority = F.regexp_extract(url, r"^https?://([^/?#]*)", 1)
    local = authority.rlike(r"^(localhost|127[.]0[.]0[.]1|0[.]0[.]0[.]0|\[::1\]|169[.]254[.]169[.]254)(:|$)")
    return F.coalesce((authority != "") & ~authority.contains("@") & ~local, F.lit(False))


def limits_valid(connect_ms: Column, total_ms: Column, body_bytes: Column, redirects: Column) -> Column:
    return F.coalesce((body_bytes > 0) & (connect_ms > 0) & (total_ms > 0) & (redirects >= 0), F.lit(False))
