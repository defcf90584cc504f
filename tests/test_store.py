"""A store written again and again, a caller's own parts, and content over a transport that fails."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from evidentia.operators import plugins
from evidentia.operators.store import COUNTERS, Store, bootstrap, made_id
from evidentia.sources import fetched

WORDS = " ".join(f"word{i}" for i in range(60))
SCHEMA = "entry_id string, kind string, collection string, title string, author string, topics array<string>, raw string"


def entry(i, raw, topics=None):
    return (i, "prepared_text", "letters", f"T{i}", None, topics, raw)


def rows(store, name):
    return sorted(map(str, store.read(name).collect()))


def test_bootstrap_twice_changes_nothing(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=4)
    one = spark.createDataFrame([entry("a", WORDS, ["x"]), entry("b", f"{WORDS} more", []), entry("c", WORDS)], SCHEMA)
    first = bootstrap(store, one).first()
    assert (first.status, *[first[c] for c in COUNTERS]) == ("bootstrapped", 3, 0, 3, 2, 1, 0, 2, 0, 2)
    before = {name: rows(store, name) for name in ("documents", "chunks", "links")}
    again = bootstrap(store, one).first()
    assert (again.status, *[again[c] for c in COUNTERS]) == ("noop", 3, 3, 0, 0, 0, 2, 2, 2, 2)
    assert {name: rows(store, name) for name in before} == before
    more = one.unionByName(spark.createDataFrame([entry("d", f"{WORDS} more"), entry("e", " ".join([WORDS + "."] * 20)), entry("f", WORDS)], SCHEMA))
    third = bootstrap(store, more).first()
    assert (third.status, *[third[c] for c in COUNTERS]) == ("bootstrapped", 6, 3, 3, 1, 2, 2, 3, 2, 5)
    assert set(before["documents"]) <= set(rows(store, "documents")) and set(before["chunks"]) <= set(rows(store, "chunks"))
    ids = {r.entry_id: r.document_id for r in store.read("links").collect()}
    assert ids["a"] == ids["c"] == ids["f"] != ids["b"] == ids["d"] and len(ids) == 6
    held = {r.entry_id: r for r in store.read("documents").collect()}
    assert held["a"].topics == ["x"] and held["b"].topics is None and held["a"].parser_version == "markers-1" and held["a"].ingested_at


def test_a_failing_entry_leaves_the_store_as_it_was(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=2)
    bootstrap(store, spark.createDataFrame([entry("a", WORDS)], SCHEMA))
    before = [rows(store, name) for name in ("documents", "chunks", "links")]
    for bad in ("too short", "", None):
        with pytest.raises(ValueError, match="without a chunk: z"):
            bootstrap(store, spark.createDataFrame([entry("y", f"{WORDS} y"), entry("z", bad)], SCHEMA))
        assert [rows(store, name) for name in ("documents", "chunks", "links")] == before
    assert bootstrap(store, spark.createDataFrame([], SCHEMA)).first().status == "noop"


def test_upserts_touch_their_buckets_only(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", buckets=8)
    chunk = lambda d, n: spark.createDataFrame([(d, i, f"{d} {i}", 1) for i in range(n)], "document_id string, chunk_index int, text string, token_count int")
    store.upsert("chunks", chunk("a", 5).unionByName(chunk("b", 2)))
    files = lambda: {str(p) for p in (tmp_path / "store/chunks").rglob("*.parquet")}
    before = files()
    store.upsert("chunks", chunk("a", 3), whole=["document_id"])
    assert store.read("chunks").groupBy("document_id").count().sort("document_id").collect() == [("a", 3), ("b", 2)]
    assert len(before & files()) == len(before) - 1
    assert spark.range(1).select(made_id(F.lit("a"), F.lit("b"))).first() != spark.range(1).select(made_id(F.lit("ab"))).first()


def test_a_callers_parser_reranker_and_extractor(spark):
    plugins.register_parser(spark, "pairs_of", lambda raw: [{"title": k, "location": str(i), "text": v} for i, (k, v) in enumerate(x.split("=", 1) for x in raw.split(";") if "=" in x)])
    docs = spark.createDataFrame([(1, "a=x;b=yy;c"), (2, ""), (3, None)], "document_id long, raw string")
    found = plugins.parse_with(docs, "pairs_of")
    assert sorted(map(tuple, found.collect())) == [(1, 0, "a", "0", "x"), (1, 1, "b", "1", "yy")]
    assert spark.sql("SELECT count(*) FROM LATERAL pairs_of('p=q;r=s')").first()[0] == 2
    rerank = plugins.Transform("longest", lambda df: df.withColumn("boosted_score", F.length("text").cast("double")), "text string", "boosted_score double")
    assert [r.boosted_score for r in rerank(found).sort("boosted_score").collect()] == [1.0, 2.0] and rerank(found).columns[:-1] == found.columns
    with pytest.raises(TypeError, match="takes text string, not nothing"):
        rerank(found.drop("text"))
    with pytest.raises(TypeError, match="gives boosted_score double, not nothing"):
        plugins.Transform("none", lambda df: df, "text string", "boosted_score double")(found)
    with pytest.raises(ValueError, match="lost title"):
        plugins.Transform("drops", lambda df: df.drop("title"), "text string", "text string")(found)


class Busy(Exception):
    status_code = 503


def _file_transport(folder, fail):
    """Reads files; each url fails so many times first, counted in files beside it, as tries may be in several processes."""

    def transport(url):
        import os

        mark = f"{folder}/{url}.tries"
        tries = os.path.getsize(mark) if os.path.exists(mark) else 0
        with open(mark, "a") as f:
            f.write("x")
        if tries < fail:
            raise type("ServiceUnavailable", (Exception,), {"status_code": 503})("not now")
        with open(f"{folder}/{url}") as f:
            return f.read()

    return transport


def test_fetching_retries_what_passes(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"u{i}").write_text(f"content {i}")
    entries = [(f"e{i}", f"u{i}") for i in range(5)]
    found = fetched.fetch(spark, entries, _file_transport(str(tmp_path), 2), fetched.Retry(3, 0.0, 0.0), each=2)
    assert found.rdd.getNumPartitions() == 3
    assert sorted(map(tuple, found.collect())) == [(f"e{i}", f"u{i}", f"content {i}", 3) for i in range(5)]
    assert fetched.fetch(spark, [], _file_transport(str(tmp_path), 0)).count() == 0
    (tmp_path / "gone").mkdir()
    with pytest.raises(PySparkException, match="entry e0 failed while"):
        fetched.fetch(spark, entries[:1], _file_transport(str(tmp_path / "gone"), 0)).collect()


def test_what_is_tried_again():
    named = lambda name: type(name, (Exception,), {})("x")
    passing = [TimeoutError(), ConnectionResetError(), Busy(), named("ReadTimeoutThing"), named("RateLimitError"), named("OverloadedError"), named("InternalServerError")]
    lasting = [ValueError(), named("NotFound"), type("E", (Exception,), {"status_code": 404})(), KeyError()]
    assert all(map(fetched.is_retryable, passing)) and not any(map(fetched.is_retryable, lasting))
    retry, slept = fetched.Retry(6, 0.5, 4.0), []

    def call():
        raise Busy()

    with pytest.raises(Busy):
        retry.run(call, slept.append)
    assert slept == [0.5, 1.0, 2.0, 4.0, 4.0]
    with pytest.raises(ValueError):
        fetched.Retry(3).run(lambda: int("x"), slept.append)
    assert len(slept) == 5
    with pytest.raises(ValueError):
        fetched.Retry(0)


def test_a_run_without_new_entries_reads_no_content(spark, tmp_path, monkeypatch):
    """F8: nothing is parsed where nothing is new."""
    from evidentia.operators import store as module

    store = Store(spark, f"file://{tmp_path}/store", buckets=2)
    one = spark.createDataFrame([entry("a", WORDS)], SCHEMA)
    bootstrap(store, one)
    monkeypatch.setattr(module.manifest, "parse_entries", lambda *_: pytest.fail("parsed"))
    assert bootstrap(store, one.withColumn("raw", F.raise_error(F.lit("read")).cast("string"))).first().status == "noop"
