"""Addresses of pages: joined to their base and in a normal form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.nodes import let

WHOLE = r"^([A-Za-z][A-Za-z0-9+.-]*):"
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"


def without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    segments = F.split(path, "/")
    start = F.filter(segments, lambda s: F.lit(False))
    last = F.get(segments, F.size(segments) - 1)
    step = lambda kept, s: F.when(s == ".", kept).when(s == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))).otherwise(F.concat(kept, F.array(s)))
    joined = F.array_join(F.aggregate(segments, start, step), "/")
    return F.when(last.isin(".", "..") & ~F.endswith(joined, F.lit("/")), F.concat(joined, F.lit("/"))).otherwise(joined)


def resolved(href: Column, base: Column) -> Column:
    """(scheme, host, path, query) of a link on a page of address ``base``; null where either is no address with a host.

    Absolute, scheme-relative, root-relative, relative, query-only and empty links are joined as
    browsers do; fragments go. Scheme and host are in lower case, default ports go.
    """
    own, at = F.trim(F.regexp_replace(href, r"[\t\r\n]", "")), F.trim(base)
    part = lambda u, n: F.regexp_extract(u, PARTS, n)
    plain = F.regexp_extract(own, r"^([^?#]*)", 1)
    query = F.regexp_extract(own, r"^[^?#]*(\?[^#]*)?", 1)
    folder = F.regexp_replace(part(at, 3), r"[^/]*$", "")
    path = F.when(F.startswith(plain, F.lit("/")), plain).when(plain == "", part(at, 3)).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), plain))
    asked = F.when((plain == "") & (query == ""), part(at, 4)).otherwise(query)
    full = F.when(own.rlike(WHOLE), own).when(F.startswith(own, F.lit("//")), F.concat(part(at, 1), F.lit(":"), own)).otherwise(F.concat(part(at, 1), F.lit("://"), part(at, 2), path, asked))

    def cut(u: Column) -> Column:
        scheme = F.lower(part(u, 1))
        host = F.regexp_replace(F.lower(part(u, 2)), r"^[^@]*@", "")
        port = F.when(scheme == "http", ":80").when(scheme == "https", ":443").otherwise(":")
        host = F.when(F.endswith(host, port), F.substr(host, F.lit(1), F.length(host) - F.length(port))).otherwise(host)
        clean = without_dots(F.when(part(u, 3) == "", "/").otherwise(part(u, 3)))
        return F.when(host != "", F.struct(scheme.alias("scheme"), host.alias("host"), clean.alias("path"), part(u, 4).alias("query")))

    return F.when(part(at, 2) != "", let(full, cut))


def normal_url(href: Column, base: Column) -> Column:
    """A link as an address to compare by: joined to its page, without fragment and closing slashes; null where there is none."""
    path = lambda r: F.regexp_replace(r["path"], "/+$", "")
    return let(resolved(href, base), lambda r: F.when(r.isNotNull(), F.concat(r["scheme"], F.lit("://"), r["host"], F.when(path(r) == "", "/").otherwise(path(r)), r["query"])))
