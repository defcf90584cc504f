import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import answers, chunking, citations, claims, guard, ingest, search, skew
from evidentia.plans.registry import Policy
from evidentia.sources import entries, manifest, markers, tei
from evidentia.streaming import ingest as stream


def test_nearest_matches_numpy(spark):
    r = np.random.default_rng(0)
    vectors = r.normal(size=(300, 8)).astype(np.float32)
    vectors[5] = 0
    vectors[7] = vectors[6]
    kinds = ["primary_text", "peer_reviewed", "other"]
    rows = [(i, kinds[i % 3], None if i == 9 else v.tolist()) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_class string, embedding array<float>")
    questions = spark.createDataFrame([(i, vectors[i].tolist()) for i in range(20) if i not in (5, 9)], "query_id long, embedding array<float>")
    k = {"primary_text": 4, "peer_reviewed": 2}
    unit = vectors.astype(float) / np.maximum(np.linalg.norm(vectors.astype(float), axis=1, keepdims=True), 1e-30)
    expected = set()
    for q in range(20):
        if q in (5, 9):
            continue
        for kind, n in k.items():
            ids = [i for i in range(300) if kinds[i % 3] == kind and i not in (5, 9)]
            expected |= {(q, i, rank) for rank, i in enumerate(sorted(ids, key=lambda i: (-round(float(unit[q] @ unit[i]), 12), i))[:n], 1)}
    for block in (4096, 7):
        got = {(r.query_id, r.chunk_id, r["rank"]) for r in search.nearest(chunks, questions, k, block=block).collect()}
        assert got == expected


def test_quota_and_grounding(spark):
    rows = [(1, 10, "peer_reviewed", 3, 1, 0.9), (1, 11, "peer_reviewed", 3, 2, 0.8), (1, 12, "primary_text", 1, 1, 0.4), (1, 13, "reference_encyclopedia", 2, 1, 0.5), (2, 20, "peer_reviewed", 3, 1, 0.9)]
    ranked = spark.createDataFrame(rows, "query_id long, chunk_id long, source_class string, stage int, rank int, score double")
    three = search.quota_select(ranked, Policy(max_chunks=3))
    assert [r.chunk_id for r in three.where("query_id = 1").orderBy("position").collect()] == [12, 13, 10]
    assert [r.chunk_id for r in search.quota_select(ranked, Policy(max_chunks=1)).where("query_id = 1").collect()] == [12]
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    levels = {r.query_id: r.level for r in search.grounding(asked, three).collect()}
    assert levels == {1: "direct", 2: "interpretive", 3: "low_confidence"}


def test_chunks_match_a_plain_loop(spark):
    r = random.Random(3)
    docs = []
    for d in range(25):
        paragraphs = [" ".join(["w"] * r.choice([1, 3, 8, 20, 40]) + ["end."]) for _ in range(r.randint(0, 9))]
        docs.append((d, 0, r.choice(["\n\n", " "]).join(paragraphs)))
    c = chunking.ChunkConfig(most=30, least=5)

    def plain(text):
        text = text.strip()
        n = len(text.split())
        if n <= c.most:
            return [(text, n)] if n >= c.least else []
        parts = [p.strip() for p in text.split("\n\n") if p.strip()]
        if len(parts) <= 1:
            parts = [p for p in text.replace("end. ", "end.\0").split("\0") if p]
        out, now = [], []
        for p in parts:
            if now and sum(len(x.split()) for x in now) + len(p.split()) > c.most:
                out.append(now)
                now = []
            now.append(p)
        if now and sum(len(x.split()) for x in now) >= c.least:
            out.append(now)
        return [("\n\n".join(x), sum(len(p.split()) for p in x)) for x in out]

    got = chunking.chunk(spark.createDataFrame(docs, "document_id long, section_index int, text string"), c).collect()
    for d, _, text in docs:
        mine = sorted((r for r in got if r.document_id == d), key=lambda r: r.chunk_index)
        assert [(r.text, r.token_count) for r in mine] == plain(text)
        assert [r.chunk_index for r in mine] == list(range(len(mine)))


def test_markers(spark):
    raw = 'intro\n[SECTION title="A" location="86b-87a" speaker="S"] gone\nline one\n  line two  \n[SECTION location="1" title="B"]\n[SECTION title="C"]\n[SECTION]\n'
    rows = markers.sections(spark.createDataFrame([(1, raw), (2, ""), (3, None)], "document_id long, raw string")).orderBy("document_id", "section_index").collect()
    assert [(r.title, r.location, r.text) for r in rows if r.document_id == 1] == [(None, None, "intro"), ("A", "86b-87a", 'line one\n  line two  \n[SECTION location="1" title="B"]'), ("C", None, "")]
    assert not [r for r in rows if r.document_id != 1]


DIALOGUE = '<TEI xmlns="http://x"><text n="Other"><body><p>no</p></body></text><text n="Meno"><body><milestone unit="section" n="70a"/><sp><speaker>Men.</speaker><p>Can you tell <note>skip</note> me?</p></sp><milestone unit="section" n="70b"/><sp><speaker>Soc.</speaker><p>No.</p></sp><sp><speaker>Men.</speaker><p>Why?</p></sp></body></text></TEI>'
TREATISE = '<TEI><text><body><div1 type="book" n="1"><milestone unit="chapter" n="2"/><p><milestone unit="page" n="1094a"/><milestone unit="line" n="1"/>Every art <milestone unit="line" n="5"/>and inquiry.</p><p>Next one.</p></div1></body></text></TEI>'


def test_tei(spark):
    d = tei.parse(DIALOGUE, "dialogue", "meno")
    assert [(x["location"], x["speaker"], x["text"]) for x in d] == [("70a", "Men", "Men: Can you tell me?"), ("70b", None, "Soc: No.\n\nMen: Why?")]
    carried = '<TEI><text><body><head>T</head><p>Before.</p><milestone unit="section" n="1"/><sp><speaker>A.</speaker><p>One <milestone unit="section" n="2"/> two</p><p>three</p></sp><p>rest</p></body></text></TEI>'
    assert [(x["title"], x["speaker"], x["text"]) for x in tei.parse(carried, "dialogue")] == [(None, None, "Before."), ("1", "A", "A: One"), ("2", "A", "A: two\n\nthree\n\nrest")]
    deep = "<TEI><text><body>" + "<div>" * 5000 + "x" + "</div>" * 5000 + "</body></text></TEI>"
    assert tei.sections(spark.createDataFrame([(1, deep, None)], "document_id long, raw string, text_id string"), "treatise").first().text == "x"
    t = tei.parse(TREATISE, "treatise")
    assert [(x["title"], x["location"], x["range_end"], x["text"]) for x in t] == [("Book 1, Chapter 2", "1094a1", "1094a5", "Every art and inquiry."), ("Book 1, Chapter 2", "1094a5", None, "Next one.")]
    df = spark.createDataFrame([(1, DIALOGUE, "meno"), (2, "<broken", None), (3, None, None)], "document_id long, raw string, text_id string")
    assert tei.sections(df, "dialogue").count() == 2


@pytest.mark.parametrize("br", ["<br>", "<br />"])
def test_entries(br):
    page = f'<html><head><title>Topic | Site</title></head><body><div class="entry-content"><h1>Topic</h1><p>Intro{br}text.</p><div class="toc"><ul><li>1. One</li></ul></div><h2>1. One</h2><p>Body &amp; more.</p><h3>a. Sub</h3><p>Under.</p><h2>2. Two</h2><p>Last.</p><h2>References and Further Reading</h2><p>Books.</p><h2>Author Information</h2><p>Ann Author</p></div></body></html>'
    title, author, found = entries.parse(page)
    assert title == "Topic" and author == "Ann Author"
    assert [(s["location"], s["title"]) for s in found] == [(None, None), ("1", "One"), ("1.a", "Sub"), ("2", "Two")]
    assert found[1]["text"] == "Body & more."
    assert entries.normalize_author("Doe, Jane; Roe, R.") == "Jane Doe; R. Roe" and entries.join_authors(["A", "B", "C"]) == "A; B; C"
    assert entries.parse("<p>x  y")[2] == [{"title": None, "location": None, "level": 0, "text": "<p>x y"}]


def test_claims():
    answer, found = claims.parse_brackets('Virtue is taught [Meno, 86b]. It is so. "Is that all?" [Plato, Meno, encyclopedia_a, 2.1; Meno 87a] Nothing more is here to say')
    assert answer == 'Virtue is taught. It is so. "Is that all?" Nothing more is here to say'
    assert [len(c["citations"]) for c in found] == [1, 2, 0]
    assert found[1]["citations"][0] == {"work": "Meno", "location": "2.1", "author": "Plato", "collection": "encyclopedia_a"} and found[1]["citations"][1]["location"] == "87a"
    assert claims.parse_brackets("No citation in here at all.")[1] == [] and claims.parse_brackets("open [bracket stays")[0] == "open [bracket stays"
    good = {"answer": " a ", "claims": [{"claim": "c", "citations": [{"work": "", "collection": "encyclopedia_a"}]}]}
    assert claims.parse_envelope("x {bad} " + json.dumps(good))[1][0]["citations"][0]["work"] == "ENCYCLOPEDIA_A"
    answer, found = claims.parse_brackets("One\nline here. [a work]\n\n\nNext  paragraph , too [encyclopedia_b 3]")
    assert answer == "One line here.\n\nNext paragraph, too"
    assert found[0]["citations"] == [{"work": "a work", "location": None, "author": None, "collection": None}] and found[1]["citations"][0]["work"] == "ENCYCLOPEDIA_B"
    assert claims.parse_citation("Ann, encyclopedia_a, §2")["author"] == "Ann" and claims.parse_citation("Of pp 3 kinds")["location"] is None
    assert claims.parse_envelope('{"a":' * 100_000) is None
    assert claims.parse_envelope('{"answer": 1}') is None and claims.parse_envelope("none") is None


def test_citations(spark):
    chunks = spark.createDataFrame([(1, 10, "dialogues", "Meno", "Plato", "virtue taught", "stephanus", "86b", None), (1, 11, "dialogues", "Meno", "Plato", "other words", "stephanus", "90a", "91b"), (2, 12, "dialogues", "Meno", "Plato", "x", None, None, None)], "query_id long, chunk_id long, collection string, work_title string, author string, text string, system string, value string, range_end string")
    cited = [(1, "a", "", "", "Meno", None, None, "86b"), (1, "b", "", "", "Meno", "Plato", None, "90b-92a"), (1, "c", "", "", "Meno", None, None, None), (1, "d", "", "", "Meno", "Kant", None, None), (2, "e", "", "", "Meno", None, None, None), (1, "f", "", "", "Meno", None, "journals_a", None)]
    df = spark.createDataFrame(cited, "query_id long, citation_id string, claim string, question string, work string, author string, collection string, location string")
    matched = citations.match(df, chunks)
    scores = {(r.citation_id, r.chunk_id): r.score for r in matched.collect()}
    assert scores == {("a", 10): 250, ("b", 11): 325, ("c", 10): 100, ("c", 11): 100, ("e", 12): 100}
    assert {r.citation_id: r.grounded for r in citations.disambiguate(matched).collect()} == {"a": True, "b": True, "c": False, "e": True}


def test_guard(spark):
    s = guard.AccessSettings("public", True, "dialogues, nowhere,encyclopedia_b", "letters")
    assert len(guard.violations(s)) == 4 and guard.violations(guard.AccessSettings()) == []
    assert guard.resolve_allowed(["b", "a"], ["c"], "local", True) == ["a", "b", "c"]
    with pytest.raises(ValueError):
        guard.resolve_allowed(["dialogues"], [], "public", False, ["letters"])
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "i int, collection string")
    assert [r.i for r in guard.leaks(df, ["a"]).collect()] == [3]


def test_ingest_and_manifest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y"), (4, None)], "doc_id long, text string")
    assert {r.doc_id: r.status for r in ingest.dedup_in_batch(docs).where("text is not null").collect()} == {1: "new", 2: "duplicate", 3: "new"}
    p = tmp_path / "m.json"
    p.write_text(json.dumps({"version": "1", "entries": [{"id": "a", "kind": "prepared_text", "collection": "dialogues", "title": "T", "author": "A", "topics": ["t"]}, {"id": "b", "kind": "tei_url", "collection": "dialogues", "title": "T", "author": "A"}]}))
    got = manifest.read(spark, str(p))
    assert got.count() == 2 and manifest.select_entries(got, ["b", "zz"]).count() == 1
    (tmp_path / "t.txt").write_text("héllo", encoding="utf-8")
    assert manifest.read_content(spark, str(tmp_path / "t.txt")).first().raw == "héllo"


def test_streaming_ingest(spark, tmp_path):
    docs = spark.createDataFrame([(1, "x", "en", "s", 1), (2, "x", "en", "s", 1), (3, "y", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = stream.write_documents(stream.first_contents(stream.read_documents(spark, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "c"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_text_folds_compatibility_characters(spark):
    cases = {"Ｆｕｌｌ ﬁne STRASSE Straße": "full fine strasse strasse", "Ἀρετή — ПРИВЕТ": "αρετη привет", "e\u0301te\u0301 ①": "ete 1"}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.n for r in df.select("t", text.normalize(F.col("t")).alias("n")).collect()} == cases


def test_expected_citations(spark):
    rows = [(1, "work=B", [("b", "Dr. Ann", None, "1\u20132", None)], [("B", "ann", None, "1-2", None)]), (2, "", [("b", None, None, None, None)], [("b", None, "c", None, None)]), (3, "", None, None)]
    df = spark.createDataFrame(rows, f"id int, answer string, citations array<{answers.CITATION}>, required_citations array<{answers.CITATION}>").withColumns({"n_citations": F.lit(1), "min_citations": F.lit(1), "level": F.lit("direct"), "tags": F.array(F.lit("t"))})
    judged = {r.id: r.failures for r in answers.judge(answers.with_tags(df, tags=["t", "u"])).collect()}
    assert judged == {1: [], 2: ["not cited: work=b, collection=c"], 3: []}
    assert answers.with_tags(df, ids=["1"]).count() == 1 and answers.with_tags(df, tags=["x"]).count() == 0


def test_hot_keys_stay_whole(spark):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.col("id").cast("string")).alias("k"))
    right = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    out = skew.join_by_key(left, right, "k", "n", 6000)
    assert out.count() == 6000 and out.where("k = 'hot' and first = 0").count() == 2000 and out.where("k is null and first is null").count() == left.where("k is null").count()
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "doc_id long, text string")
    assert [(r.doc_id, r.status) for r in ingest.dedup_in_batch(docs).orderBy("doc_id").collect()] == [(1, "new"), (2, "duplicate"), (3, "new"), (4, "new")]


def test_cases_and_reports(spark, tmp_path):
    case = {"id": "a", "question": "q", "tags": ["t"], "expectations": {"must_contain": ["yes"], "required_citations": [{"work": "W"}], "max_unsupported": 2}}
    (tmp_path / "cases.json").write_text(json.dumps({"cases": [case, {"id": "b", "tags": [], "expectations": {}}]}))
    cases = answers.read_cases(spark, str(tmp_path / "cases.json"))
    assert [(r.id, r.min_citations, r.max_ungrounded, r.max_unsupported) for r in cases.orderBy("id").collect()] == [("a", 1, 0, 2), ("b", 1, 0, 0)]
    cited = F.array(F.struct(F.lit("w").alias("work"), *[F.lit(None).cast("string").alias(k) for k in ("author", "collection", "location", "source_class")]))
    responses = cases.withColumns({"answer": F.lit("Oh YES."), "citations": cited, "works": F.array(F.lit("w")), "level": F.lit("direct"), "n_citations": F.when(F.col("id") == "a", 1).otherwise(0), "n_ungrounded": F.lit(0), "n_unsupported": F.lit(1)})
    judged = answers.judge(responses)
    assert {r.id: r.failures for r in judged.collect()} == {"a": [], "b": ["too few citations", "too many unsupported claims"]}
    answers.write_report(judged, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report" / "summary")).first().passed == 1


def test_entries_become_documents_and_chunks(spark):
    entries_ = spark.createDataFrame([("a", "dialogues", []), ("b", "encyclopedia_a", ["x"])], "id string, collection string, topics array<string>")
    rows = {r.id: r for r in manifest.metadata(entries_).collect()}
    assert rows["a"].source_class == "primary_text" and rows["a"].topics is None and rows["b"].topics == ["x"] and rows["a"].ingested_at is not None
    docs = spark.createDataFrame([(1, "prepared_text", '[SECTION title="T" location="1a"]\n' + "w " * 60), (2, "tei_url", DIALOGUE), (3, "html_file", "<p>x</p>"), (4, "prepared_text", None)], "document_id long, kind string, raw string")
    found = manifest.parse(docs)
    chunks = chunking.chunk_as("section", found)
    assert {r.document_id: (r.n_sections, r.n_chunks, r.status) for r in manifest.dry_run(docs, found, chunks).collect()} == {1: (1, 1, "ready"), 2: (1, 0, "failed"), 3: (1, 0, "failed"), 4: (0, 0, "failed")}
    with pytest.raises(Exception, match="no parser for kind pdf"):
        manifest.parse(docs.withColumn("kind", F.lit("pdf"))).collect()
    with pytest.raises(ValueError):
        chunking.chunk_as("window", found)
    vectors = chunks.select("document_id", "chunk_index", F.array(F.lit(1.0)).alias("embedding"))
    assert ingest.with_embeddings(chunks, vectors).first().embedding == [1.0]
    with pytest.raises(Exception, match="no embedding"):
        ingest.with_embeddings(chunks, vectors.limit(0)).collect()


def test_revision_dates(spark):
    lines = {"First published Mon Jan 3, 2000; substantive revision Tue February 15, 2011": "2011-02-15", "Sept. of no year": "Sept. of no year", "May 1 1999": "1999-05-01"}
    df = spark.createDataFrame([(k,) for k in lines], "t string")
    assert {r.t: r.d for r in df.select("t", entries.revision_date(F.col("t")).alias("d")).collect()} == lines


def test_paragraphs_that_begin_or_end_with_their_number(spark):
    """only spaces are trimmed from a paragraph, not the digits of its place."""
    lines = ["0 is first 0", "1 second 1", "  2 third 2  ", "3 " + "w " * 600]
    found = chunking.chunk(spark.createDataFrame([(1, 0, "\n\n".join(lines))], "document_id long, section_index int, text string"), chunking.ChunkConfig(512, 1)).orderBy("chunk_index").collect()
    assert [c.text for c in found] == ["0 is first 0\n\n1 second 1\n\n2 third 2", ("3 " + "w " * 600).strip()]


def test_sentences_that_begin_with_their_number(spark):
    """a sentence keeps the digits that are its place among the sentences."""
    parts = ["Zero.", "1 is first 1.", "23 second.", "3"]
    assert spark.createDataFrame([(" ".join(parts),)], "t string").select(chunking.parts_of(F.col("t"))).first()[0] == parts


def test_batch_keeps_digits_at_the_border_of_sentences(spark):
    """from raw text to chunks, no digit goes missing."""
    words = " ".join(f"{i} " + "w " * 60 + "end." for i in range(12))
    docs = spark.createDataFrame([(1, words)], "doc_id long, text string")
    stored = spark.createDataFrame([], "raw_hash string")
    found = ingest.ingest(docs, stored, lambda d: d.select("document_id", F.lit(0).alias("section_index"), F.col("raw").alias("text"))).orderBy("chunk_index").collect()
    assert " ".join(" ".join(c.text for c in found).split()) == " ".join(words.split())


def test_tei_text_after_a_closing_straight_quote():
    """a straight quote that ends a word closes, and a space follows; one that stands alone or after a space opens."""
    text = lambda body: tei.parse(f"<TEI><text><body><p>{body}</p></body></text></TEI>", "dialogue")[0]["text"]
    assert text('token = "ab"<note>no</note> more') == 'token = "ab" more'
    assert text('he said "<note>no</note>more" so') == 'he said "more" so'
    assert text("he said “<note>no</note> more”") == "he said “more”"


def test_sentences_at_odd_spaces(spark):
    """borders lose all of Unicode's space separators; a vertical tab is no white space, in sentences and in counts."""
    text = "\u00a0One. \u3000Two\u2003. Three.\x0bFour!\f\x0bFive.\u202f"
    df = spark.createDataFrame([(text,), ("a\x0bb c",)], "t string")
    assert df.select(chunking.parts_of(F.col("t"))).first()[0] == ["One.", "Two\u2003.", "Three.\x0bFour!", "\x0bFive."]
    assert [r[0] for r in df.select(chunking.word_count(F.col("t"))).collect()] == [4, 2]


def test_batch_at_odd_spaces_as_sql(spark, tmp_path):
    """the query gives its SQL's chunks of texts with every kind of space, at borders and near the bounds of tokens."""
    duckdb = pytest.importorskip("duckdb")
    from evidentia.plans import catalog

    spaces = "\t\x0b\f\r \x1c\x85\u00a0\u1680\u2003\u202f\u205f\u3000\u200b\u2028"
    rows = [(i * 3 + k, t) for i, c in enumerate(spaces) for k, t in enumerate((f"{c}One{c}two.{c}" + "w " * 520 + f"end. {c}Last!{c}", "w " * 49 + f"v{c}u", "w " * 511 + f"v.{c}u"))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    expected = c.execute(f"select document_id, chunk_index, text, token_count from ({catalog.ORACLE_SQL['ingest_batch']}) order by 1, 2").fetchall()
    found = catalog.QUERIES["ingest_batch"](spark, str(tmp_path)).select("document_id", "chunk_index", "text", "token_count").orderBy("document_id", "chunk_index").collect()
    assert len(expected) > 30 and [tuple(r) for r in found] == expected


@pytest.mark.parametrize("name", ["bracket_claims", "bracket_answers"])
def test_brackets_of_odd_texts_as_sql(spark, tmp_path, name):
    """F2 of round 4: texts that are blank, begin with closing signs or hold an envelope, and texts with every kind of space."""
    duckdb = pytest.importorskip("duckdb")
    from evidentia.plans import catalog

    spaces = "\t\x0b\f\r \n\x1c\x85\u00a0\u1680\u2003\u202f\u205f\u3000\u200b\u2028"
    texts = [f"{x}{y}" for x in ("", " ", "\n\n ", *"\"')]}»”’", ".", ";") for y in ("", " ", " ,", "Said who would know. \"So\" it goes on and on", '" One two three four. Five')]
    texts += [t for c in spaces for t in (c, f"{c}One{c}two three four.{c}Five{c}, six{c}\n{c}\nseven eight.{c}", f'{c}"One{c}{c}two.')]
    texts += ['Here: {"answer": "One two.", "claims": [{"claim": "Three."}]} and four more words', '{"answer": "five"}']
    spark.createDataFrame([(i, t, f"src{i % 7}") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = catalog.QUERIES[name](spark, str(tmp_path))
    expected = sorted(c.execute(f"select {', '.join(df.columns)} from ({catalog.ORACLE_SQL[name]})").fetchall())
    assert len(expected) >= len(texts) and sorted(tuple(r) for r in df.collect()) == expected
