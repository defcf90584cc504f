"""Encyclopedia entries in HTML: title, authors, preamble and numbered sections; tables of contents and references are skipped."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = "entries-2"
SCHEMA = "document_id long, section_index int, title string, location string, level int, author string, text string"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Dialect:
    """root: class or id of the entry's div. skip: classes or ids of parts to skip. ends: headings at which the entry ends."""

    root: tuple[str, ...] = ("entry-content", "main-text", "article-content")
    skip: tuple[str, ...] = ("toc", "table-of-contents")
    ends: tuple[str, ...] = ("references and further reading", "bibliography", "academic tools", "other internet resources", "related entries")
    authors: str = "author information"


def heading_parts(text: str, top: str | None, anchor: str | None = None) -> tuple[str | None, str, str | None]:
    """Location, title and current top number of `1. Title`, `1.2 Title` and `a. Title` (which is under the top number, if there is one).

    A heading without any is placed by its anchor: H1 is section 1, SH1a its part a.
    """
    if m := re.match(r"^(\d+(?:\.\d+)*)\.?\s+(.*)$", text):
        return m[1], m[2], m[1].split(".")[0]
    if m := re.match(r"^([a-zA-Z])\.\s+(.*)$", text):
        return ".".join(x for x in (top, m[1].lower()) if x), m[2], top
    if m := re.fullmatch(r"H(\d+)", anchor or ""):
        return m[1], text, m[1]
    if m := re.fullmatch(r"SH(\d+)([a-zA-Z])", anchor or ""):
        return f"{m[1]}.{m[2].lower()}", text, m[1]
    return None, text, top


def normalize_author(raw: str) -> str:
    """`Last, First; Last, First` as `First Last; First Last`."""
    names = [x.strip() for x in raw.split(";") if x.strip()]
    return "; ".join(" ".join([p.strip() for p in n.split(",", 1)][::-1]) if "," in n else n for n in names)


def author_line(lines: list[str]) -> str | None:
    """The first line that can be a name."""
    return next((x for x in lines if x.strip() and x.strip().casefold() not in ("and", "u. s. a.", "u.s.a.") and not x.casefold().startswith("email")), None)


def join_authors(names: list[str]) -> str | None:
    return None if not names else names[0] if len(names) == 1 else " and ".join(names) if len(names) == 2 else "; ".join(names)


class _Entry(HTMLParser):
    def __init__(self, d: Dialect):
        super().__init__(convert_charrefs=True)
        self.d, self.depth, self.skipping, self.done = d, 0, 0, False
        self.stack: list[str] = []
        self.title, self.page_title, self.meta_author, self.top = None, None, None, None
        self.sections: list[dict] = []
        self.now = {"title": None, "location": None, "level": 0, "parts": []}
        self.heading: tuple[str, list[str]] | None = None
        self.anchor: str | None = None
        self.plain: list[str] | None = None
        self.author_lines: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta" and (a.get("name") or "").lower() in ("citation_author", "dc.creator"):
            self.meta_author = "; ".join(x for x in (self.meta_author, a.get("content")) if x)
        if tag in _VOID:
            if self.depth and tag == "br":
                self.now["parts"].append("\n")
            return
        names = {*(a.get("class") or "").split(), a.get("id") or ""}
        if self.depth:
            self.depth += 1
            self.stack.append(tag)
            if self.skipping:
                self.skipping += 1
            elif names & {*self.d.skip}:
                self.skipping = 1
        elif tag == "div" and names & {*self.d.root}:
            self.depth, self.stack = 1, ["div"]
        if tag in ("h1", "h2", "h3", "h4") and not self.skipping and (self.depth or tag == "h1"):
            self.heading, self.anchor = (tag, []), a.get("id")
        elif tag == "a" and self.heading:
            self.anchor = self.anchor or a.get("name") or a.get("id")
        elif tag == "title":
            self.plain = []
        elif tag in ("p", "li", "blockquote") and self.depth:
            self.now["parts"].append("\n\n")

    def handle_endtag(self, tag):
        if tag == "title" and self.plain is not None:
            self.page_title, self.plain = " ".join("".join(self.plain).split()), None
        if self.heading and tag == self.heading[0]:
            self._headed(tag, " ".join("".join(self.heading[1]).split()))
            self.heading = None
        if self.depth and tag in self.stack:
            while self.stack:
                last = self.stack.pop()
                self.depth -= 1
                self.skipping = max(0, self.skipping - 1)
                if last == tag:
                    break

    def handle_data(self, data):
        if self.plain is not None:
            self.plain.append(data)
        elif self.heading:
            self.heading[1].append(data)
        elif self.depth and not self.skipping:
            if self.author_lines is not None:
                self.author_lines += data.split("\n")
            elif not self.done:
                self.now["parts"].append(re.sub(r"\s+", " ", data))

    def _headed(self, tag, text):
        if tag == "h1":
            self.title = self.title or text
            return
        if self.d.authors in text.casefold():
            self.author_lines = []
            return
        self.author_lines = self.author_lines and None
        if any(text.casefold().endswith(x) for x in self.d.ends):
            self._close()
            self.done = True
            return
        if self.done:
            return
        self._close()
        location, title, self.top = heading_parts(text, self.top, self.anchor)
        self.now = {"title": title, "location": location, "level": int(tag[1]) - 1, "parts": []}

    def _close(self):
        text = re.sub(r" ?\n ?", "\n", re.sub(r"\n{2,}", "\n\n", re.sub(r"[ \t]+", " ", "".join(self.now["parts"])))).strip()
        if text:
            self.sections.append({k: self.now[k] for k in ("title", "location", "level")} | {"text": text})
        self.now = {"title": None, "location": None, "level": 0, "parts": []}


def parse(raw: str, d: Dialect = Dialect()) -> tuple[str | None, str | None, list[dict]]:
    """Title, author, sections; without an entry's div one section of the whole page, white space squeezed."""
    e = _Entry(d)
    e.feed(raw)
    e.close()
    lines = e.author_lines or []
    e._close()
    page_title = re.sub(r"\s+[|–-]\s+[^|]*$", "", e.page_title) if e.page_title else None
    title = e.title or page_title
    author = normalize_author(e.meta_author) if e.meta_author else join_authors([x for x in [author_line(lines)] if x])
    found = e.sections or [{"title": title, "location": None, "level": 0, "text": re.sub(r"\s+", " ", raw).strip()}]
    return title, author, found


def revision_date(line: Column) -> Column:
    """ISO date of the last month, day and year that a publication line gives; the line itself where there is none."""
    said = F.try_element_at(F.regexp_extract_all(line, F.lit(r"([A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})"), F.lit(1)), F.lit(-1))
    flat = F.regexp_replace(F.regexp_replace(said, r"[.,]", ""), r"\s+", " ")
    day = F.coalesce(F.try_to_timestamp(flat, F.lit("MMM d yyyy")), F.try_to_timestamp(flat, F.lit("MMMM d yyyy")))
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), line)


def sections(docs: DataFrame, d: Dialect = Dialect()) -> DataFrame:
    """docs (document_id, raw) to sections. A null document has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["raw"] is None:
                    continue
                _, author, found = parse(r["raw"], d)
                rows += [{"document_id": r["document_id"], "section_index": i, "author": author, **s} for i, s in enumerate(found)]
            kinds = [("document_id", pa.int64()), ("section_index", pa.int32()), ("title", pa.string()), ("location", pa.string()), ("level", pa.int32()), ("author", pa.string()), ("text", pa.string())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return docs.select("document_id", "raw").mapInArrow(run, SCHEMA)
