"""TEI XML: dialogues (a section per milestone) and treatises (a section per paragraph, chapter or book, with carried page and line)."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

VERSION = "tei-2"
SCHEMA = "document_id long, section_index int, title string, location string, range_end string, speaker string, text string"


def _name(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def find_work(root: ET.Element, text_id: str | None) -> ET.Element | None:
    """The text with this n, or whose head says so, of several in one file; without an id the first one. Only texts that hold no
    other text count; namespaces don't matter."""
    parent = {x: e for e in root.iter() for x in e}
    works, outer = [e for e in root.iter() if _name(e) == "text"], set()
    for e in works:
        up = parent.get(e)
        while up is not None and _name(up) != "text":
            up = parent.get(up)
        outer.add(up)
    works = [e for e in works if e not in outer]
    if text_id is None:
        return works[0] if works else None
    for e in works:
        head = next((h for h in e.iter() if _name(h) == "head"), None)
        if (e.get("n") or "").casefold() == text_id.casefold() or (head is not None and "".join(head.itertext()).strip().casefold() == text_id.casefold()):
            return e
    return None


#: Elements whose text is not part of a section.
_ASIDE = frozenset(("note", "bibl", "castList", "speaker", "label", "head"))


#: What ends a text that the next one follows without a space: a space, an opening sign, or a straight quote that opens, as no sign stands
#: right before it.
_OPENING = re.compile(r'(?:[ \n“‘(]|(?:^|[\s“‘(\[])")$')


class _Section:
    """Text of one section: paragraphs, and the speaker who is named before the next text."""

    def __init__(self, location: str | None, speaker: str | None):
        self.location, self.next, self.speakers, self.parts = location, speaker, [], []

    def paragraph(self) -> None:
        if self.parts and self.parts[-1] != "\n\n":
            self.parts.append("\n\n")

    def add(self, text: str | None) -> None:
        text = " ".join((text or "").split())
        if not text:
            return
        if self.next is not None:
            self.parts.append(f"{self.next}: ")
            self.speakers += [self.next] * (self.next not in self.speakers)
            self.next = None
        if self.parts and not _OPENING.search(self.parts[-1][-2:]):
            self.parts.append(" ")
        self.parts.append(text)

    def row(self) -> dict:
        paragraphs = [" ".join(x.split()) for x in "".join(self.parts).split("\n\n")]
        return {"title": self.location, "location": self.location, "range_end": None, "speaker": self.speakers[0] if len(self.speakers) == 1 else None, "text": "\n\n".join(x for x in paragraphs if x)}


def dialogue_sections(work: ET.Element) -> Iterator[dict]:
    """A section from each milestone of unit section to the next, titled by it; text before the first one has none.

    A speech begins with `Name: `, again in the next section where it goes on over a milestone. Notes, heads and lists of the
    cast are left out. The section's speaker is given if there is one only.
    """
    now, speaker = _Section(None, None), None
    # what is left to do: enter an element, add the text after it, or give the word back to an earlier speaker
    todo: list[tuple] = [("enter", next((x for x in work.iter() if _name(x) == "body"), work))]
    while todo:
        kind, e = todo.pop()
        if kind == "tail":
            now.add(e.tail)
            continue
        if kind == "back":
            speaker = e
            continue
        name = _name(e)
        if name in _ASIDE or not name:
            continue
        if name == "milestone":
            if e.get("unit") == "section":
                if now.parts:
                    yield now.row()
                now = _Section(e.get("n"), speaker)
            continue
        if name in ("said", "sp"):
            who = next((" ".join("".join(x.itertext()).split()).rstrip(".:") for x in e if _name(x) in ("speaker", "label")), (e.get("who") or "").lstrip("#"))
            todo.append(("back", speaker))
            speaker = who or speaker
            if speaker:
                now.paragraph()
                now.next = speaker
        elif name == "p":
            now.paragraph()
        now.add(e.text if name != "sp" else None)
        for x in reversed(e):
            todo += [("tail", x), ("enter", x)]
    if now.parts:
        yield now.row()


def treatise_sections(work: ET.Element) -> Iterator[dict]:
    """Sections titled by book and chapter, each from the page and line of its first word to those of its last.

    A paragraph, a new book and a new chapter each begin one, a chapter in the midst of a paragraph too. A chapter that repeats its book's
    number is shown without it. Notes, heads and lists are left out; text outside of paragraphs counts.
    """
    marks: dict[str, str | None] = dict.fromkeys(("book", "chapter", "page", "line"))
    parts: list[str] = []
    places: list[str | None] = []

    def ended() -> Iterator[dict]:
        text = " ".join("".join(parts).split())
        if text:
            book, chapter = marks["book"], marks["chapter"]
            if book and chapter:
                chapter = chapter.removeprefix(f"{book}.")
            title = ", ".join(f"{k} {v}" for k, v in (("Book", book), ("Chapter", chapter)) if v)
            known = [p for p in places if p]
            first, last = (known[0], known[-1]) if known else (None, None)
            yield {"title": title or None, "location": first, "range_end": last if last != first else None, "speaker": None, "text": text}
        parts.clear()
        places.clear()

    def add(text: str | None) -> None:
        if text and text.strip():
            places.append(f"{marks['page']}{marks['line'] or ''}" if marks["page"] else None)
        if text:
            parts.append(text)

    todo: list[tuple[str, ET.Element | None]] = [("enter", next((x for x in work.iter() if _name(x) == "body"), work))]
    while todo:
        kind, e = todo.pop()
        if kind == "tail":
            add(e.tail)
            continue
        if kind == "end":
            yield from ended()
            continue
        name = _name(e)
        if name in _ASIDE or not name:
            continue
        if name == "milestone":
            unit, n = (e.get("unit") or e.get("type") or "").lower(), " ".join((e.get("n") or "").split())
            mark = next((m for m, w in (("page", "page"), ("line", "line"), ("chapter", "chap")) if w in unit), None)
            if mark and n:
                if mark == "chapter":
                    yield from ended()
                marks[mark] = n
                if mark == "page":
                    marks["line"] = None
            continue
        n = " ".join((e.get("n") or "").split())
        if name in ("div1", "div") and (e.get("type") or "book").lower() == "book" and n:
            yield from ended()
            marks["book"], marks["chapter"] = n, None
        if name == "p":
            yield from ended()
            todo.append(("end", None))
        add(e.text)
        for x in reversed(e):
            todo += [("tail", x), ("enter", x)]
    yield from ended()


def parse(raw: str, mode: str, text_id: str | None = None) -> list[dict]:
    work = find_work(ET.fromstring(raw), text_id)
    return [] if work is None else list((dialogue_sections if mode == "dialogue" else treatise_sections)(work))


def sections(docs: DataFrame, mode: str) -> DataFrame:
    """docs (document_id, raw, text_id) to sections; a document that isn't well-formed XML, or is nested beyond
    what a parser takes, has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    found = parse(r["raw"] or "", mode, r.get("text_id"))
                except (ET.ParseError, RecursionError):
                    found = []
                rows += [{"document_id": r["document_id"], "section_index": i, **s} for i, s in enumerate(found)]
            kinds = [("document_id", pa.int64()), ("section_index", pa.int32()), *((n, pa.string()) for n in ("title", "location", "range_end", "speaker", "text"))]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kinds))

    return docs.mapInArrow(run, SCHEMA)
