"""A second kind of encyclopedia entry in HTML: metadata in meta tags, a preamble, dotted section numbers, parts to skip and sections at which the text ends.

The state machine knows what each open element is for: an element passes its use on to those within, unless they have one of their
own. So a list of contents is skipped down to its own end, however deep it is nested.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from evidentia.sources.entries import normalize_author

VERSION = "numbered-1"
SCHEMA = "document_id long, section_index int, title string, location string, level int, author string, updated string, entry_title string, text string"
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS, _HEADINGS = frozenset(("p", "li")), {"h2": 1, "h3": 2, "h4": 3}
_NUMBER = re.compile(r"(\d+(?:\.\d+)*)\.? +(.+)")
_REVISED = re.compile(r"substantive revision \w+ (\w+) (\d{1,2}), (\d{4})")


@dataclass(frozen=True)
class Numbered:
    # Ids of the parts of a page, names of its metadata, and where the text ends.
    root: str = "aueditable"
    skip: tuple[str, ...] = ("toc",)
    preamble: str = "preamble"
    published: str = "pubinfo"
    title: str = "citation_title"
    author: str = "citation_author"
    modified: str = "DCTERMS.modified"
    end_ids: tuple[str, ...] = ("Bib", "Aca", "Oth", "Rel")
    end_titles: tuple[str, ...] = ("bibliography", "academic tools", "other internet resources", "related entries", "acknowledgments")


def squeezed(text: str) -> str:
    return " ".join(text.split())


def published_date(line: str) -> str | None:
    """The ISO date of the substantive revision that a publication line names, else the line."""
    line = squeezed(line)
    if m := _REVISED.search(line):
        for form in ("%b %d %Y", "%B %d %Y"):
            try:
                return datetime.strptime(" ".join(m.groups()), form).date().isoformat()
            except ValueError:
                continue
    return line or None


class _Page(HTMLParser):
    """Uses of elements: page (outside of the entry), skip, info, lead, body, and those of one piece of text: title, head, block."""

    def __init__(self, d: Numbered):
        super().__init__(convert_charrefs=True)
        self.d = d
        self.title = self.author = self.updated = None
        self.open: list[tuple[str, str]] = []
        self.words: list[str] = []
        self.level, self.anchor = 1, None
        self.lead: list[str] = []
        self.found: list[dict] = []
        self.now: dict | None = None
        self.over = False

    def use(self) -> str:
        return self.open[-1][1] if self.open else "page"

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "meta":
            self.told(a.get("property") or a.get("name"), a.get("content"))
        if tag in _VOID:
            if tag == "br" and self.use() == "block":
                self.words.append("\n")
            return
        use = self.use()
        new = self.begins(use, tag, a)
        if new in ("title", "head", "block", "info") and new != use or (new == "block" and tag in _BLOCKS):
            self.piece_ends(use)
            self.words = []
        if new == "head" and tag in _HEADINGS:
            self.level, self.anchor = _HEADINGS[tag], a.get("id")
        elif new == "head" and tag == "a":  # else the name of an anchor in it
            self.anchor = self.anchor or a.get("name")
        self.open.append((tag, new))

    def begins(self, use: str, tag: str, a: dict) -> str:
        """The use of an element that opens within another use."""
        name = a.get("id") if tag == "div" else None
        if use == "page":
            return "body" if name == self.d.root else "page"
        if use in ("skip", "info") or name in self.d.skip:
            return "skip" if use != "info" else "info"
        if name == self.d.preamble:
            return "lead"
        if name == self.d.published:
            return "info"
        if tag == "h1":
            return "title"
        if tag in _HEADINGS and not self.over:
            return "head"
        if tag in _BLOCKS and not self.over and use != "head":
            return "block"
        return use

    def handle_endtag(self, tag):
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        while at is not None and len(self.open) > at:
            use = self.open.pop()[1]
            if use != self.use() or tag in _BLOCKS and use == "block":
                self.piece_ends(use)

    def handle_data(self, data):
        if self.use() in ("title", "head", "block", "info"):
            self.words.append(data)

    def close(self):
        super().close()
        self.piece_ends(self.use())
        self.section_ends()
        if self.lead:
            self.found.insert(0, {"title": "Preamble", "location": None, "level": 0, "text": "\n\n".join(self.lead)})

    def told(self, name, content):
        if content is None:
            return
        if name == self.d.title:
            self.title = squeezed(content)
        elif name == self.d.author:
            self.author = normalize_author(squeezed(content))
        elif name == self.d.modified:
            self.updated = squeezed(content)

    def piece_ends(self, use: str) -> None:
        """What was gathered is the piece that the use says."""
        text, self.words = squeezed("".join(self.words)), []
        if use == "info":
            self.updated = self.updated or published_date(text)
        elif use == "title":
            self.title = self.title or text
        elif use == "head" and text:
            self.heading(text)
        elif use == "block" and text and not self.over:
            if any(u == "lead" for _, u in self.open):
                self.lead.append(text)
            elif self.now:
                self.now["parts"].append(text)

    def heading(self, text: str) -> None:
        m = _NUMBER.fullmatch(text)
        location, title = m.groups() if m else (None, text)
        self.section_ends()
        if self.anchor in self.d.end_ids or title.casefold() in self.d.end_titles:
            self.over = True
        else:
            self.now = {"title": title, "location": location, "level": self.level, "parts": []}
        self.anchor = None

    def section_ends(self) -> None:
        if self.now and self.now["parts"]:
            self.found.append({k: self.now[k] for k in ("title", "location", "level")} | {"text": "\n\n".join(self.now["parts"])})
        self.now = None


def parse(raw: str, d: Numbered = Numbered()) -> tuple[str | None, str | None, str | None, list[dict]]:
    """Title, author, last update, sections; without a section, one of the whole page, white space squeezed."""
    page = _Page(d)
    page.feed(raw)
    page.close()
    found = page.found or [{"title": page.title, "location": None, "level": 0, "text": squeezed(raw)}]
    return page.title, page.author, page.updated, found


def sections(docs: DataFrame, d: Numbered = Numbered()) -> DataFrame:
    """docs (document_id, raw) to sections. A null document has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["raw"] is not None:
                    title, author, updated, found = parse(r["raw"], d)
                    rows += [{"document_id": r["document_id"], "section_index": i, "author": author, "updated": updated, "entry_title": title, **s} for i, s in enumerate(found)]
            texts = [(n, pa.string()) for n in ("author", "updated", "entry_title", "text")]
            kinds = [("document_id", pa.int64()), ("section_index", pa.int32()), ("title", pa.string()), ("location", pa.string()), ("level", pa.int32()), *texts]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return docs.select("document_id", "raw").mapInArrow(run, SCHEMA)
