"""Crawled pages: visible text, meta tags, links, URL rules and reachability."""

from __future__ import annotations

import re
from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from corpusloom.sources.scratch import shared_folder

HIDDEN = {"script", "style", "nav", "footer"}
#: Elements whose content is characters up to their end tag, without markup.
RAW = {"script": re.compile(r"</script(?=[\s/>])", re.I), "style": re.compile(r"</style(?=[\s/>])", re.I)}
# An attribute: a name, and after = a value in quotes or up to the next space. Possessive, so that no tag is tried twice.
_ATTRIBUTE = r"[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|(?![\"'])([^\s>]*+)))?+"
_ATTRIBUTES = re.compile(_ATTRIBUTE)
_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"  # a comment, to the end where it isn't closed
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:" + _ATTRIBUTE.replace("([", "(?:[") + r")*+)[\s/]*+>"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*+>?",  # declarations and what isn't a tag
    re.S,
)
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("meta", T.MapType(T.StringType(), T.StringType())), T.StructField("base", T.StringType()), T.StructField("hrefs", T.ArrayType(T.StringType()))])


def _attributes(source: str) -> dict[str, str | None]:
    """Names in lower case to decoded values, None where there is none; the last of equal names counts."""
    out = {}
    for m in _ATTRIBUTES.finditer(source):
        value = next((v for v in m.groups()[1:] if v is not None), None)
        out[m[1].lower()] = None if value is None else unescape(value)
    return out


def read_page(source: str) -> tuple[str, dict[str, str], str | None, list[str]]:
    """Text, meta tags, base reference and link references of a page, in one pass over its markup.

    Text nodes are stripped, empty ones dropped, one a line; those inside HIDDEN elements are left out. The first base
    with a reference counts; links are those of a elements, wherever they stand.
    """
    texts, meta, base, hrefs, hidden = [], {}, None, [], []
    at = done = 0

    def text(upto: int) -> None:
        if not hidden and (node := unescape(source[done:upto]).strip()):
            texts.append(node)

    while m := _MARKUP.search(source, at):
        text(m.start())
        at = done = m.end()
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in hidden:
                while hidden.pop() != tag:
                    pass
            continue
        if tag in HIDDEN:
            hidden.append(tag)
            if tag in RAW:
                found = RAW[tag].search(source, at)
                at = done = found.start() if found else len(source)
        elif tag in ("a", "meta", "base"):
            a = _attributes(m["attributes"])
            if tag == "meta":
                if (name := a.get("name") or a.get("property")) and a.get("content") is not None:
                    meta[name.lower()] = a["content"]
            elif (href := a.get("href")) is not None:
                if tag == "a":
                    hrefs.append(href.strip(" \t\n\r\f"))
                elif base is None:
                    base = href.strip(" \t\n\r\f")
    text(len(source))
    return "\n".join(texts), meta, base, hrefs


@pandas_udf(PAGE)
def page(html: pd.Series) -> pd.DataFrame:
    """Vectorized helper: read_page() of each page; a null page is empty."""
    return pd.DataFrame([read_page(h or "") for h in html], columns=PAGE.names)


def visible_text(html: Column | str) -> Column:
    """Text nodes, stripped, one a line; script, style, nav, footer and comments are left out."""
    return page(html)["text"]


def meta_map(html: Column | str) -> Column:
    """meta name or property in lower case to content, the last one wins."""
    return page(html)["meta"]


@pandas_udf(T.StringType())
def join_url(base: pd.Series, href: pd.Series) -> pd.Series:
    """Vectorized helper for relative references with dots."""
    return pd.Series([None if b is None or h is None else urljoin(b, h) for b, h in zip(base, href, strict=True)])


def resolve(url: Column, href: Column) -> Column:
    """A reference against its page; those with . or .. steps go through join_url."""
    origin = F.regexp_extract(url, r"^([a-z]+://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"^([a-z]+://[^/?#]*/(?:[^?#]*/)?)", 1)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, r"^([a-z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href == "", url)
        .when(href.startswith("?"), F.concat(F.regexp_extract(url, r"^([^?#]*)", 1), href))
        .when(href.startswith("#"), F.concat(F.regexp_extract(url, r"^([^#]*)", 1), href))
        .otherwise(F.concat(F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder), href))
    )


def _resolved(base: Column, href: Column) -> Column:
    return F.when(href.rlike(r"(^|/)\.\.?(/|$)"), join_url(base, href)).otherwise(resolve(base, href))


def links(pages: DataFrame) -> DataFrame:
    """(src, dst): every link of every page, resolved against its base reference, or against its URL where it has none."""
    read = pages.select(F.col("url").alias("src"), page("html").alias("page"))
    base = F.when(F.col("page.base") != "", _resolved(F.col("src"), F.col("page.base"))).otherwise(F.col("src"))
    found = read.select("src", base.alias("base"), F.explode("page.hrefs").alias("href"))
    return found.select("src", _resolved(F.col("base"), F.col("href")).alias("dst"))


def host_of(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))


def allowed(urls: DataFrame, domains: DataFrame, url: str = "url") -> DataFrame:
    """URLs whose host is, or is below, a domain in domains(domain): an equi-join on the host's endings."""
    parts = F.split(host_of(F.col(url)), r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    wanted = domains.select(F.col("domain").alias("__domain")).distinct()
    seen = urls.withColumn("__n", F.monotonically_increasing_id()).where(host_of(F.col(url)).isNotNull())
    hits = seen.withColumn("__ending", F.explode(endings)).join(wanted, F.col("__ending") == F.col("__domain"), "left_semi")
    return hits.dropDuplicates(["__n"]).drop("__n", "__ending")


def reachable(link: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """(url, depth) of what seeds(url) reach in at most `depth` links, with the least depth; one join a round.

    Rounds are checkpointed, so plans don't grow with depth.
    """
    shared_folder(link.sparkSession)  # checkpoints need one
    link = link.distinct()
    seen = seeds.select("url").distinct().withColumn("depth", F.lit(0)).checkpoint()
    front = seen
    for d in range(1, depth + 1):
        step = front.join(link, front.url == link.src).select(F.col("dst").alias("url")).distinct()
        front = step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(d)).checkpoint()
        if front.isEmpty():
            break
        seen = seen.unionByName(front).checkpoint()
    return seen


def content_kind(content_type: Column) -> Column:
    bare = F.lower(F.trim(F.split(content_type, ";")[0]))
    return F.when(bare == "text/html", "html").when(bare.contains("pdf"), "pdf").when(bare.rlike("msword|officedocument.wordprocessing"), "docx").otherwise("skip")


def file_key(url: Column, longest: int = 100) -> Column:
    """A name that is safe in file systems; long names are cut and marked with a digest."""
    bare = F.regexp_replace(F.regexp_replace(url, "^https?://", ""), r'[<>:"/\\|?*&#=]', "_")
    short = F.concat(F.substring(bare, 1, 50), F.lit("_"), F.substring(F.md5(bare), 1, 8))
    return F.when(bare == "", F.concat(F.lit("unknown_"), F.substring(F.md5(url), 1, 8))).when(F.length(bare) > longest, short).otherwise(bare)
