"""Stored listing pages -> listing rows.

Pages are landed HTML (page_id, url, html, and source where portals differ).
``page_listings`` takes every linked list item; ``portal_listings`` reads the
five layouts of single portals, one spec row each, dispatched by source.  A
page scan is a plain projection + explode over whole pages, in built-in
functions; paged results (A11) are simply more rows of the same table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.functions.text import strip_ws

# list item with a link: <li><a href="...">text</a></li>
LIST_LINK_RE = r'<li><a href="([^"]*)">([^<]*)</a></li>'
BASE_RE = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"


def page_listings(pages: DataFrame) -> DataFrame:
    """(page_id, pos, href, job_uri, title) for every linked list item."""
    base = F.regexp_extract("url", BASE_RE, 1)
    hrefs = F.regexp_extract_all("html", F.lit(LIST_LINK_RE), 1)
    texts = F.regexp_extract_all("html", F.lit(LIST_LINK_RE), 2)
    z = pages.select("page_id", base.alias("_base"), F.arrays_zip(hrefs.alias("href"), texts.alias("title")).alias("_z"))
    e = z.select("page_id", "_base", F.posexplode("_z").alias("pos", "_l"))
    href = F.col("_l.href")
    uri = F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href).otherwise(F.concat(F.col("_base"), href))
    return e.select("page_id", F.col("pos").cast("bigint").alias("pos"), href.alias("href"),
                    uri.alias("job_uri"), F.col("_l.title").alias("title"))


def last_line(c) -> F.Column:
    """The last non-blank line of a text cell."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip_ws), lambda x: x != "")
    return F.try_element_at(lines, F.lit(-1))


# ------------------------------------------------------------ portal layouts
@dataclass(frozen=True)
class Layout:
    """How one portal marks a listing.  Each field is a pattern over the
    item's HTML whose first group is the field; ``cells`` takes the fields
    from numbered table cells instead, of rows with ``least_cells`` at least."""
    item: str
    title: str
    href: str
    company: str | None = None
    date: tuple[str, ...] = ()
    description: str | None = None
    cells: dict | None = None
    least_cells: int = 0
    relative: bool = False         # the link is relative to the portal
    trimmed: bool = False
    no_date: str | None = None     # text for a missing date


def _tag(name: str, attribute: str) -> str:
    """An element with an attribute (a pattern), its content as the group."""
    return rf"(?s)<{name}\b(?=[^>]*{attribute})[^>]*>(.*?)</{name}>"


def _link(attribute: str = "") -> str:
    return rf'(?s)<a\b(?=[^>]*{attribute})[^>]*\bhref="([^"]*)"'


# The marks of the five layouts.
_BLOCK_COMPANY = 'class="spacing-5-5 font-size-14 ff-helvetica-neuehelveticaarialsans-serif fc-60-60-60-255 w3 s p wf"'
_BLOCK_DATE = 'class="hc cptr fc-66-156-218-255 s e wf ccx ccy sbt notxt focusable"'
LAYOUTS = {
    "mercell": Layout(item=r"(?s)<tr\b(?=[^>]*\broworder\b)[^>]*>(?:(?!<th\b).)*?</tr>",
                      title=_tag("a", r'\bclass="(?:[^"]* )?hide100pct[ "]'), href=_link(r'\bclass="(?:[^"]* )?hide100pct[ "]'),
                      company=_tag("a", r'\bclass="(?:[^"]* )?company-in-grid[ "]'), date=(r"(?s)^(.*)$",),
                      cells={"title": 4, "href": 4, "company": 4, "date": 5}, least_cells=7, relative=True, trimmed=True),
    "witted": Layout(item=_tag("li", r"\bdata-list-item\b").replace("(.*?)", ".*?"), title=_tag("h2", ""),
                     href=_link(), description=_tag("p", "")),
    "emagine": Layout(item=_tag("article", "").replace("(.*?)", ".*?"), title=_tag("h2", 'class="title"'),
                      href=_link('class="single-job"'),
                      date=(_tag("span", 'id="convertedDate"'), _tag("div", 'class="start-date"'))),
    "verama": Layout(item=_tag("a", 'class="route-section"').replace("(.*?)", ".*?"),
                     title=_tag("span", r'class="(?:[^"]* )?job-request-record__header[ "]'), href=_link(), relative=True),
    "folq": Layout(item=rf"(?s)<a\b[^>]*href=(?:(?!</a>).)*</a>(?:(?!<a\b).)*?<div {_BLOCK_COMPANY}>(?:(?!<a\b).)*",
                   title=_tag("a", ""), href=_link(), company=_tag("div", _BLOCK_COMPANY),
                   date=(_tag("div", _BLOCK_DATE),), relative=True, no_date="Snarest"),
}


def _text(html: Column) -> Column:
    """Text of an element: tags dropped, the five named entities decoded."""
    t = F.regexp_replace(html, "<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(char))
    return t


def layout_listings(pages: DataFrame, layout: Layout, base: Column) -> DataFrame:
    """(page_id, pos, title, job_uri, company, description, delivery_date) of
    the pages of one layout; a field the item lacks is null (a trimmed layout
    gives empty text)."""
    items = pages.select("page_id", base.alias("_base"),
                         F.posexplode(F.regexp_extract_all("html", F.lit(layout.item), 0)).alias("pos", "_i"))
    if layout.least_cells:
        items = items.withColumn("_td", F.regexp_extract_all("_i", F.lit(r"(?s)<td\b[^>]*>(.*?)</td>"), 1)).where(
            F.size("_td") >= layout.least_cells)

    def raw(field: str, pattern: str | None) -> Column:
        if pattern is None:
            return F.lit(None).cast("string")
        where = F.get("_td", F.lit(layout.cells[field])) if layout.cells else F.col("_i")
        return F.when(where.rlike(pattern), F.regexp_extract(where, pattern, 1))

    def text(field: str, pattern: str | None) -> Column:
        t = _text(raw(field, pattern))
        return strip_ws(F.coalesce(t, F.lit(""))) if layout.trimmed and pattern else t

    date = F.coalesce(*[text("date", d) for d in layout.date]) if layout.date else F.lit(None).cast("string")
    if len(layout.date) > 1:
        date = last_line(date)
    if layout.no_date:
        date = F.coalesce(date, F.lit(layout.no_date))
    href = raw("href", layout.href)
    if layout.relative:
        href = F.concat(F.col("_base"), F.coalesce(href, F.lit("")))
    return items.select("page_id", F.col("pos").cast("bigint").alias("pos"), text("title", layout.title).alias("title"),
                        href.alias("job_uri"), text("company", layout.company).alias("company"),
                        (F.lit("") if layout.cells else text("description", layout.description)).alias("description"),
                        date.alias("delivery_date"))


def portal_listings(pages: DataFrame) -> DataFrame:
    """``layout_listings`` of every known source; other sources yield nothing."""
    base = F.regexp_extract("url", BASE_RE, 1)
    out = None
    for source, layout in LAYOUTS.items():
        rows = layout_listings(pages.where(F.col("source") == source), layout, base).withColumn("source", F.lit(source))
        out = rows if out is None else out.unionByName(rows)
    return out
