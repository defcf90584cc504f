"""The second dialect of HTML entries, treatises in TEI, and the dispatch by kind and collection."""

import json

import pytest
from pyspark.errors import PySparkException

from evidentia.operators import answers, claims
from evidentia.sources import entries, manifest, numbered, tei

PAGE = """<!DOCTYPE html><html><head><meta property="citation_title" content="On  Forms"/><meta property="citation_author" content="Silver, Anna; Stone, Ben"/></head><body>
<div id="header"><p>Menu</p></div><div id="aueditable"><h1>Other title</h1>
<div id="pubinfo"><em>First published Mon Jun 9, 2003; substantive revision Mon July 14, 2014</em></div>
<div id="preamble"><p>First   words.</p><p>More &amp; more.<br>Next line.</p></div>
<div id="toc"><ul><li>1. Part<ul><li>1.1 Inner<div><p>deep</p></div></li></ul></li></ul><!-- c --></div>
<p>Before any section.</p>
<h2><a name="1">1. The Background</a></h2><p>Text one.</p><ul><li>Item <em>one</em></li><li><p>Item two</p></li></ul>
<h3 id="1.1">1.1 The <i>Meno</i></h3><p>Text two.
<h4>No number</h4><p>Text three.</p><h3>1.2 Empty</h3>
<h2><a name="Bib">Works</a></h2><p>Not this.</p><h2>2. Nor this</h2><p>No.</p></div><p>Footer</p></body></html>"""


def test_second_dialect():
    title, author, updated, found = numbered.parse(PAGE)
    assert (title, author, updated) == ("On Forms", "Anna Silver; Ben Stone", "2014-07-14")
    assert [(s["title"], s["location"], s["level"], s["text"]) for s in found] == [
        ("Preamble", None, 0, "First words.\n\nMore & more. Next line."),
        ("The Background", "1", 1, "Text one.\n\nItem one\n\nItem two"),
        ("The Meno", "1.1", 2, "Text two."),
        ("No number", None, 3, "Text three."),
    ]
    meta = PAGE.replace("</head>", '<meta name="DCTERMS.modified" content="2020-01-02"/></head>')
    assert numbered.parse(meta)[2] == "2020-01-02"
    assert [s["title"] for s in numbered.parse(PAGE.replace('<a name="Bib">Works</a>', "Acknowledgments"))[3]][-1] == "No number"
    assert numbered.published_date("First published Mon Jun 9, 2003") == "First published Mon Jun 9, 2003"


@pytest.mark.parametrize("raw", ["", "plain   words", "<div id='aueditable'>", "</div></p>" * 5, "<div id='aueditable'><h2>1. A</h2><p>cut of", "<p>" * 3000 + "x"])
def test_odd_pages_of_the_second_dialect(raw):
    found = numbered.parse(raw)[3]
    assert len(found) == 1
    assert found[0]["text"] == ("cut of" if "cut" in raw else " ".join(raw.split()))


TREATISE = """<TEI><text n="w"><body><div1 type="book" n="1"><head>Book I</head><milestone unit="chapter" n="1.1"/><milestone unit="page" n="1094a"/><milestone unit="line" n="1"/>
<p>Every art <note>no</note>aims at <milestone unit="line" n="20"/>good.</p><p>Second <milestone unit="chapter" n="1.2"/>one <milestone unit="page" n="1094b"/><milestone unit="line" n="1"/>goes on.</p>
loose words</div1><div1 type="book" n="2"><p></p><p>Of virtue.</p></div1></body></text></TEI>"""


def test_treatises():
    found = tei.parse(TREATISE, "treatise", "w")
    assert [(s["title"], s["location"], s["range_end"], s["text"]) for s in found] == [
        ("Book 1, Chapter 1", "1094a1", "1094a20", "Every art aims at good."),
        ("Book 1, Chapter 1", "1094a20", None, "Second"),
        ("Book 1, Chapter 2", "1094a20", "1094b1", "one goes on."),
        ("Book 1, Chapter 2", "1094b1", None, "loose words"),
        ("Book 2", "1094b1", None, "Of virtue."),
    ]


def test_dispatch(spark):
    rows = [
        (1, "tei_url", "dialogues", '<TEI><text><body><milestone unit="section" n="2a"/><p>Said.</p></body></text></TEI>'), (2, "tei_url", "treatises", TREATISE), (3, "html_file", "encyclopedia_a", "<p>only</p>"),
        (4, "html_url", "encyclopedia_b", PAGE), (5, "prepared_text", "journals_a", "words"), (6, "html_url", "letters", '[SECTION title="A"]\nwords'), (7, "prepared_text", "dialogues", None),
    ]
    schema = "document_id long, kind string, collection string, raw string"
    found = manifest.parse_entries(spark.createDataFrame(rows, schema)).collect()
    count = lambda i: sum(s.document_id == i for s in found)
    assert [count(i) for i in range(1, 8)] == [1, 5, 1, 4, 1, 1, 0]
    assert {s.document_id: s.parser_version for s in found} == {1: tei.VERSION, 2: tei.VERSION, 3: entries.VERSION, 4: numbered.VERSION, 5: "markers-1", 6: "markers-1"}
    for kind, collection in (("tei_url", "letters"), ("html_file", "nowhere"), (None, None)):
        with pytest.raises(PySparkException, match="no parser for kind"):
            manifest.parse_entries(spark.createDataFrame([(1, kind, collection, "x")], schema)).collect()
    assert manifest.parse_entries(spark.createDataFrame([], schema)).count() == 0


def test_headings_of_entries_by_number_letter_and_anchor():
    page = (
        '<div class="entry-content"><h2>a. Early</h2><p>x</p><h2 id="H1">First</h2><p>x</p><h3><a name="SH1B"></a>Inner</h3><p>x</p><h3>c. Lettered</h3><p>x</p><h2><a id="H2"></a>2. Second</h2><p>x</p>'
        '<h3>A. Upper</h3><p>x</p><h3 id="other">Plain</h3><p>x</p></div>'
    )
    found = entries.parse(page)[2]
    assert [(s["location"], s["title"]) for s in found] == [("a", "Early"), ("1", "First"), ("1.b", "Inner"), ("1.c", "Lettered"), ("2", "Second"), ("2.a", "Upper"), (None, "Plain")]


def test_manifest_entries_need_their_fields(spark, tmp_path):
    full = {"id": "a", "kind": "html_file", "collection": "letters", "title": "T", "author": "A"}
    write = lambda *rows: (tmp_path / "m.json").write_text(json.dumps({"version": "1", "entries": rows}))
    write(full, full | {"id": "b", "topics": ["x"]})
    assert [r.id for r in manifest.read(spark, f"{tmp_path}/m.json").collect()] == ["a", "b"]
    for field in manifest.REQUIRED:
        write(full, {k: v for k, v in full.items() if k != field})
        with pytest.raises(PySparkException, match=f"manifest entry 1 lacks {field}"):
            manifest.read(spark, f"{tmp_path}/m.json").collect()


def test_evaluation_cases_are_checked(spark, tmp_path):
    case = {"id": "a", "question": "q", "expectations": {"required_citations": [{"work": "w"}]}}
    write = lambda *rows: (tmp_path / "c.json").write_text(json.dumps({"cases": rows}))
    write(case, case | {"id": "b"})
    assert {r.id for r in answers.read_cases(spark, f"{tmp_path}/c.json").collect()} == {"a", "b"}
    for other, said in (({"id": "a"}, "used twice"), ({"expectations": {"any_citations": [{"work": None}]}}, "names nothing"), ({"expectations": {"min_citations": -1}}, "negative")):
        write(case, {**case, "id": "b", **other})
        with pytest.raises(PySparkException, match=said):
            answers.read_cases(spark, f"{tmp_path}/c.json").collect()


def test_answers_without_claims_are_read_for_brackets(spark):
    cite = {"answer": "Virtue is knowledge [Meno, 87d].", "claims": []}
    claim = {"answer": "So.", "claims": [{"claim": "c", "citations": [{"work": "W"}]}]}
    rows = [(1, json.dumps(cite)), (2, json.dumps(claim)), (3, "It is so [Meno 80a] and more."), (4, None), (5, json.dumps({"answer": "None at all.", "claims": []}))]
    found = {r.query_id: r for r in claims.parse_outputs(spark.createDataFrame(rows, "query_id long, raw_output string"), cited=True).collect()}
    assert found[1].claims == [] and [c.work for x in found[1].cited for c in x.citations] == ["Meno"] and found[1].form == "json"
    assert all(found[i].cited == found[i].claims for i in (2, 3, 4, 5)) and found[3].cited and not found[5].cited


def test_entries_are_made_from_words_cut_once(spark):
    """a text is cleaned and cut once, not for each part that uses its words."""
    from evidentia.plans import corpus

    plan = corpus._entry_kinds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2
