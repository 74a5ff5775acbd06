"""Operator 4, URL filters with redirect equivalence.

Rules (action, host, path) fit a url whose host is theirs or below it and
whose path starts with theirs; the longest fitting rule decides.  Pages that
no rule fits take the decision of their aliases: urls linked by redirects or
canonical links form connected components; a component with an explicitly
allowed url is allowed, else one with a blocked url is blocked, else allowed.
A rule of the page itself always comes first.

Aliases come from the pages (canonical link elements and meta refreshes, their
character references decoded and relative targets resolved against the page's
url or its base element) and from ``redirects`` (src, dst) of absolute urls,
such as a crawler's log.
A url's node is its host, path and query: scheme and fragment don't matter.

Everything is DataFrame functions; pages are narrowed to (url, links) in one
scan, and only rows that take part in a link are joined.

Defined results: a null url, or one without ``://``, has empty host and path,
fits no rule, has no alias and is allowed; repeated urls are judged alike;
other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lineax.llm.common import connected_components
from lineax.session import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    action: str  # allow or block
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def query_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))


def best_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The name of the longest rule that fits (of equally long ones the one with the longer host, then a block), else null."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.action != "block", r.name))
    out = F.lit(None).cast("string")
    for r in reversed(ranked):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(f"{r.action} {r.name}")).otherwise(out)
    return out


#: Named references; in attributes those without ``;`` count unless a letter, digit or ``=`` follows.
_OPEN = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n)))
_NUMBER = "#[0-9]+;?|#[xX][0-9a-fA-F]+;?"
REFERENCE = rf"&(?:{_NUMBER}|[A-Za-z][A-Za-z0-9]*;|(?:{_OPEN})(?![A-Za-z0-9=;]))"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def decode_references(text: Column) -> Column:
    """``text`` of an attribute with its character references decoded; unknown names stay."""
    names = F.from_json(F.lit(json.dumps({"&" + n: c for n, c in html5.items()})), "map<string,string>")

    def one(x: Column) -> Column:
        hexed = F.regexp_extract(x, "^&#[xX]0*([0-9a-fA-F]*)", 1)
        digits = F.regexp_extract(x, "^&#0*([0-9]*)", 1)
        is_hex = F.regexp_like(x, F.lit("^&#[xX]"))
        # longer numbers are no characters
        point = F.when(is_hex, F.when(F.length(hexed) <= 6, F.conv(hexed, 16, 10))).when(F.length(digits) <= 7, digits)
        point = F.when(point != "", point.cast("int"))
        fits = point.between(1, 0xD7FF) | point.between(0xE000, 0x10FFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(F.when(fits, point).otherwise(0xFFFD)), 8, "0")), "UTF-32")
        return F.when(x.startswith("&#") & (F.length(x) > 2), char).otherwise(F.coalesce(F.try_element_at(names, x), x))

    parts = F.regexp_extract_all(text, F.lit(rf"(?s){REFERENCE}|[^&]+|&"), F.lit(0))
    return F.when(text.contains("&"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def _without_dots(steps: Column) -> Column:
    kept = F.aggregate(steps, F.slice(steps, 1, 0), lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(x == ".", acc).otherwise(F.concat(acc, F.array(x))))
    # a path that ends in a dot step names a folder
    return F.array_join(F.concat(kept, F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.slice(steps, 1, 0))), "/")


def resolve(ref: Column, base: Column) -> Column:
    """``ref`` as an absolute url, seen from ``base`` (RFC 3986); null where it names no host."""
    root = F.regexp_extract(base, r"(?s)^.*?://[^/?#]*", 0)
    path, tail = F.regexp_extract(ref, r"(?s)^[^?#]*", 0), F.regexp_extract(ref, r"(?s)^[^?#]*(.*)$", 1)
    whole = F.concat(F.when(path.startswith("/"), "").otherwise(F.regexp_extract(path_of(base), r"(?s)^/(?:.*/)?", 0)), path)
    # of "/a/b", and of "a/b" under a base without path
    plain = _let(F.split(F.regexp_replace(whole, "^/", ""), "/"), _without_dots)
    return (F.when(F.regexp_like(ref, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*://")), ref).when(F.regexp_like(ref, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:")), F.lit(None))
            .when(ref.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?:)//", 1), ref))
            .when(path != "", F.concat(root, F.lit("/"), plain, tail))
            .when(ref.startswith("?"), F.concat(root, path_of(base), tail))
            .otherwise(F.concat(root, path_of(base), query_of(base), tail)))


def page_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst) urls of canonical link elements and meta refreshes."""
    html, href = F.col(html_col), r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
    canonical = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<link\b([^>]*)>"), F.lit(1)), lambda a: F.regexp_like(a, F.lit(r"""(?is)\brel\s*=\s*["']?[^"'>]*\bcanonical\b""")))
    refresh = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)<meta\b([^>]*)>"), F.lit(1)), lambda a: F.regexp_like(a, F.lit(r"""(?is)\bhttp-equiv\s*=\s*["']?refresh""")))
    # a ; ends the url of a refresh, but not where it ends a reference
    target = rf"""(?is)\burl\s*=\s*["']?\s*((?:&(?:{_NUMBER}|[A-Za-z][A-Za-z0-9]*;)|[^"'\s>;])+)"""
    to = F.concat(F.transform(canonical, lambda a: F.regexp_extract(a, href, 1)), F.transform(refresh, lambda a: F.regexp_extract(a, target, 1)))
    first = F.regexp_extract(F.regexp_extract(html, r"(?is)<base\b([^>]*\bhref\b[^>]*)>", 1), href, 1)
    base = F.coalesce(F.when(first != "", _let(decode_references(first), lambda x: resolve(x, F.col(url_col)))), F.col(url_col))
    refs = F.transform(F.filter(to, lambda x: x != ""), decode_references)
    dst = _let(base, lambda b: F.transform(refs, lambda x: resolve(x, b)))
    found = pages.where(F.col(url_col).contains("://") & (F.regexp_like(html, F.lit("(?i)canonical|refresh"))))
    return found.select(F.col(url_col).alias("src"), F.explode(dst).alias("dst")).where(F.col("dst").contains("://"))


def _node(url: Column) -> Column:
    return F.concat(host_of(url), path_of(url), query_of(url))


def judge_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """(id_col, url, host, path, rule, verdict, alias_verdict) of every row."""
    url = F.col("url")
    links = page_links(pages, url_col, html_col) if html_col else None
    if redirects is not None:
        redirects = redirects.select("src", "dst").where(F.col("src").contains("://") & F.col("dst").contains("://"))
        links = redirects if links is None else links.union(redirects)
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).withColumn("host", host_of(url)).withColumn("path", path_of(url))
    found = best_rule(F.col("host"), F.col("path"), rules)
    base = base.withColumn("found", found).withColumn("node", F.when(F.col("host") != "", _node(url)))
    if links is None:
        out = base.withColumn("alias", F.lit(None).cast("string"))
    else:
        ends = materialize(links.select(F.col("src"), F.col("dst"), _node(F.col("src")).alias("a"), _node(F.col("dst")).alias("b")).where("a <> b").distinct(), "links")
        members = connected_components(ends.select("a", "b"))
        urls = ends.select(F.col("a").alias("node"), F.col("src").alias("url")).union(ends.select("b", "dst"))
        own = urls.groupBy("node").agg(F.min("url").alias("url")).select("node", best_rule(host_of(url), path_of(url), rules).alias("own"))
        seen = members.join(own, "node")
        decided = seen.groupBy("component").agg(F.bool_or(F.col("own").startswith("allow")).alias("allows"), F.bool_or(F.col("own").startswith("block")).alias("blocks"))
        alias = seen.join(decided, "component").select("node", F.when(F.col("allows"), "allow").when(F.col("blocks"), "block").alias("alias"))
        out = base.join(materialize(alias, "aliases"), "node", "left")
    verdict = F.coalesce(F.substring_index("found", " ", 1), "alias", F.lit("allow"))
    return out.select(F.col("id").alias(id_col), "url", "host", "path", F.expr("substring(found, instr(found, ' ') + 1)").alias("rule"), verdict.alias("verdict"), F.col("alias").alias("alias_verdict"))
