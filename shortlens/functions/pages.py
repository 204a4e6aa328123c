"""Fields out of raw HTML. Python runs only here, over Arrow batches, because nesting needs a parser."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from shortlens.functions.fixed_values import JOB_CARD, JOB_PAGE, WALL_CLASS

VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNREAD_TAGS = frozenset(("script", "style", "template"))

RECORD_TYPE = "struct<title:string,description:string,location:string,post_time:string,criterias:map<string,string>>"
CARDS_TYPE = "array<struct<url:string,benefits:string,posted:string,company:string>>"


class Element:
    """One element: its attributes, the pieces inside it in order, and where its content lies in the page."""

    def __init__(self, tag: str, attrs: dict, start: int):
        self.tag, self.attrs, self.start, self.end = tag, attrs, start, None
        self.inside: list[Element | str] = []

    def matches(self, tag: str, cls: str | None) -> bool:
        """A class matches as the whole attribute or as one of its names; several names must all be there."""
        if self.tag != tag:
            return False
        have = self.attrs.get("class") or ""
        return cls is None or have == cls or set(cls.split()) <= set(have.split())

    def elements(self) -> Iterator[Element]:
        stack = self.inside[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, Element):
                yield node
                stack.extend(node.inside[::-1])

    def find(self, tag: str, cls: str | None = None) -> Element | None:
        return next(self.find_all(tag, cls), None)

    def find_all(self, tag: str, cls: str | None = None) -> Iterator[Element]:
        return (e for e in self.elements() if e.matches(tag, cls))

    def strings(self) -> Iterator[str]:
        stack = self.inside[::-1]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                yield node
            elif node.tag not in UNREAD_TAGS:
                stack.extend(node.inside[::-1])

    def text(self) -> str:
        return "".join(s.strip() for s in self.strings())


class PageReader(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.line_starts = [0]
        for line in html.split("\n"):
            self.line_starts.append(self.line_starts[-1] + len(line) + 1)
        self.root = Element("", {}, 0)
        self.open = [self.root]
        self.feed(html)
        self.close()
        for element in self.open:
            element.end = len(html)

    def place(self) -> int:
        line, column = self.getpos()
        return self.line_starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        element = Element(tag, dict(attrs), self.place() + len(self.get_starttag_text()))
        self.open[-1].inside.append(element)
        if tag in VOID_TAGS:
            element.end = element.start
        else:
            self.open.append(element)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.open.pop().end = self.place() + len(self.get_starttag_text())

    def handle_endtag(self, tag):
        if any(e.tag == tag for e in self.open[1:]):
            while True:
                element = self.open.pop()
                element.end = self.place()
                if element.tag == tag:
                    return

    def handle_data(self, data):
        self.open[-1].inside.append(data)

    def inner(self, element: Element) -> str:
        return self.html[element.start : element.end]


def element_fields(html: Column, fields: dict[str, tuple]) -> Column:
    """A struct of texts, the page read once: name -> (tag, class or None, inner HTML wanted or not)."""

    def one(page):
        if page is None:
            return [None] * len(fields)
        reader = PageReader(page)
        found = [(reader.root.find(tag, cls), inner) for tag, cls, inner in fields.values()]
        return [None if e is None else reader.inner(e) if inner else e.text() for e, inner in found]

    @F.pandas_udf("struct<" + ",".join(f"`{name}`:string" for name in fields) + ">")
    def read(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(page) for page in pages], columns=list(fields), dtype=object)

    return read(html)


def element_text(html: Column, tag: str, cls: str | None = None, inner: bool = False) -> Column:
    """Text, or inner HTML, of the first element with the tag and class; null without one."""
    return element_fields(html, {"text": (tag, cls, inner)})["text"]


def simple_element(html: Column, tag: str) -> Column:
    """Inner HTML of the first element of a tag that cannot hold itself, such as title or h1, without Python."""
    pattern = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"
    return F.when(html.rlike(pattern), F.regexp_extract(html, pattern, 1))


def job_record(html: Column, marks: dict = JOB_PAGE, wall: tuple = ("a", WALL_CLASS)) -> Column:
    """The post on a page as a struct; null behind a sign-in wall or without a description."""

    def one(page):
        if page is None:
            return None
        reader = PageReader(page)
        root = reader.root
        body = root.find(*marks["description"])
        if root.find(*wall) is not None or body is None or not reader.inner(body):
            return None
        record = {"description": reader.inner(body), "criterias": {}}
        for field in ("title", "location", "post_time"):
            found = root.find(*marks[field]) if field in marks else None
            record[field] = None if found is None else found.text()
        listed = root.find(*marks["criteria_list"]) if "criteria_list" in marks else None
        for item in listed.find_all(*marks["criteria_item"]) if listed else ():
            name, value = item.find(*marks["criteria_name"]), item.find(*marks["criteria_value"])
            if name is not None and value is not None:
                record["criterias"]["".join(name.strings()).strip()] = "".join(value.strings()).strip()
        return record

    # Whole pages go in and most of each comes out, so they pass a hundred at a time and not by Arrow batches of thousands.
    return F.udf(one, RECORD_TYPE, useArrow=False)(html)


def job_cards(html: Column, marks: dict = JOB_CARD) -> Column:
    """The cards of a list page: link, badge, date and company; a card without a link is left out."""

    def one(page):
        if page is None:
            return None
        cards = []
        for card in PageReader(page).root.find_all(*marks["card"]):
            link = card if marks["card"] == marks["link"] else card.find(*marks["link"])
            if link is None or not link.attrs.get("href"):
                continue
            badge, time, company = (card.find(*marks[m]) if m in marks else None for m in ("benefits", "posted", "company"))
            cards.append(
                {
                    "url": link.attrs["href"],
                    "benefits": None if badge is None else "".join(badge.strings()).strip(),
                    "posted": None if time is None else time.attrs.get("datetime"),
                    "company": None if company is None else "".join(company.strings()),
                }
            )
        return cards

    @F.pandas_udf(CARDS_TYPE)
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(one).astype(object)

    return read(html)
