"""HTML and sitemap XML columns: regular expressions over whole documents.

Every pattern stays in the subset that Java and RE2 read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from webcairn import limits as L
from webcairn.functions.text import collapse

HIDDEN = r"(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<!--.*?-->"
TITLE_TEXT = r"(?is)<title\b[^>]*>([^<]+)"
H1_BODY = r"(?is)<h1\b[^>]*>(.*?)</h1\s*>"
FIRST_TEXT = r"(?s)^(?:<[^>]*>)*([^<]*)"
PARAGRAPH = r"(?is)<p(?:\s[^>]*)?>(.*?)</p\s*>"
REOPENED = r"(?is)^.*<p(?:\s[^>]*)?>"
ANY_TAG = r"(?s)<[^>]*>"
ANCHOR_TAG = r"(?is)<a(?:\s[^>]*)?>"
META_TAG = r"(?is)<meta(?:\s[^>]*)?>"
QUOTES = r"^[\"']|[\"']$"


def visible(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, HIDDEN, "")


def attribute(tag: Column, name: str) -> Column:
    """Raw attribute value, empty when absent."""
    raw = F.regexp_extract(tag, rf"(?is)\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.regexp_replace(raw, QUOTES, "")


def title_text(html: Column) -> Column:
    return collapse(F.regexp_extract(html, TITLE_TEXT, 1))


def h1_text(html: Column) -> Column:
    """First text node inside an h1, nested tags included."""
    bodies = F.regexp_extract_all(html, F.lit(H1_BODY), F.lit(1))
    texts = F.transform(bodies, lambda b: F.regexp_extract(b, FIRST_TEXT, 1))
    first = F.get(F.filter(texts, lambda t: t != ""), 0)
    return F.nullif(collapse(first), F.lit(""))


def snippet_text(html: Column) -> Column:
    """First long enough paragraph; a paragraph opened inside another starts over."""
    blocks = F.regexp_extract_all(html, F.lit(PARAGRAPH), F.lit(1))
    texts = F.transform(
        blocks,
        lambda b: collapse(F.regexp_replace(F.regexp_replace(b, REOPENED, ""), ANY_TAG, "")),
    )
    usable = F.filter(texts, lambda t: F.length(t) >= L.MIN_SNIPPET_CHARS)
    return F.substring(F.get(usable, 0), 1, L.MAX_SNIPPET_CHARS)


def meta_tags(html: Column) -> Column:
    """Meta tags with content, in document order: name, property, content."""
    tags = F.regexp_extract_all(html, F.lit(META_TAG), F.lit(0))
    parsed = F.transform(
        tags,
        lambda t: F.struct(
            F.lower(attribute(t, "name")).alias("name"),
            F.lower(attribute(t, "property")).alias("property"),
            attribute(t, "content").alias("content"),
        ),
    )
    return F.filter(parsed, lambda m: m["content"] != "")


def meta_content(tags: Column, field: str, value: str) -> Column:
    return F.get(F.filter(tags, lambda m: m[field] == value), 0)["content"]


def hrefs(html: Column, most: int | None = None) -> Column:
    """Raw non-empty link targets in document order: all, or the first ``most``."""
    tags = F.regexp_extract_all(html, F.lit(ANCHOR_TAG), F.lit(0))
    targets = F.filter(F.transform(tags, lambda t: attribute(t, "href")), lambda h: h != "")
    return targets if most is None else F.slice(targets, 1, most)


def fingerprint(*fields: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *[F.coalesce(f, F.lit("")) for f in fields]), 256)


def xml_text(text: Column) -> Column:
    """Element text without CDATA wrapper, entities decoded (ampersand last)."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?is)^<!\[CDATA\[(.*?)\]\]>$", "$1"))
    return xml_entities(bare)


def xml_entities(text: Column) -> Column:
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def element(block: Column, name: str) -> Column:
    """Text of the first element of that local name, null when absent."""
    pattern = rf"(?is)<(?:[\w.\-]+:)?{name}\b[^>]*>\s*(.*?)\s*</(?:[\w.\-]+:)?{name}>"
    return F.when(
        block.rlike(pattern), xml_text(F.regexp_extract(block, pattern, 1))
    )


def blocks(xml: Column, name: str) -> Column:
    """Inner text of every element of that (unprefixed) name."""
    return F.regexp_extract_all(xml, F.lit(rf"(?is)<{name}\b[^>]*>(.*?)</{name}>"), F.lit(1))


def atom_link(entry: Column) -> Column:
    """Preferred link: the first alternate ends the search, a rel-less link beats an earlier one."""
    tags = F.transform(
        F.regexp_extract_all(entry, F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)),
        lambda t: F.struct(
            xml_entities(F.trim(attribute(t, "href"))).alias("href"),
            t.rlike(r"(?is)\srel\s*=\s*[\"']").alias("has_rel"),
            (F.lower(F.trim(attribute(t, "rel"))) == "alternate").alias("alternate"),
        ),
    )
    usable = F.filter(tags, lambda t: t["href"] != "")
    alternate = F.filter(usable, lambda t: t["alternate"])
    relless = F.filter(usable, lambda t: ~t["has_rel"])
    return F.coalesce(
        F.get(alternate, 0)["href"],
        F.get(relless, F.size(relless) - 1)["href"],
        F.get(usable, 0)["href"],
    )
