"""Carried state over ranges of rows: running counts, the last value, marked files as lines; and normal forms of all of Unicode."""

import random
import unicodedata

from pyspark.sql import functions as F

from evidentia.functions import text
from evidentia.operators import scan
from evidentia.sources import markers


def test_running_matches_a_loop(spark):
    """One key holds most rows, some are null, places repeat."""
    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 1, 2, None]), r.choice([None, *range(400)]), r.choice([None, None, "x", "y"]), r.randrange(9)) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k long, at long, v string, n long").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as many ranges as there are partitions
    try:
        found = scan.running(df, ["k"], ["at", "v", "n"], {"i": scan.COUNT, "sum": scan.total("n"), "x": scan.xor("n"), "last": scan.latest("v")}).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(found) == len(rows)
    for k in (1, 2, None):
        mine = sorted((x for x in rows if x[0] == k), key=lambda x: [(v is not None, v or 0) if i != 2 else (v is not None, v or "") for i, v in enumerate(x)])
        count = total = mixed = 0
        last = None
        for want, got in zip(mine, sorted((x for x in found if x.k == k), key=lambda x: x.i)):
            count, total, mixed, last = count + 1, total + want[3], mixed ^ want[3], want[2] or last
            assert (got.k, got["at"], got.v, got.n, got.i, got["sum"], got.x, got["last"]) == (*want, count, total, mixed, last)
    assert scan.running(df.limit(0), ["k"], ["at"], {"i": scan.COUNT}).count() == 0


FILE = "before\n[SECTION title=\"A\" location=\"1a\" speaker=\"S\"] dropped\nline one\n\nline two\n[SECTION]\n\n[SECTION title=\"Empty\"]\n  [SECTION location=\"2b\"]\nlast  \n"


def test_marked_files_as_lines_and_as_rows(spark, tmp_path):
    r = random.Random(2)
    files = {i: "\n".join(r.choice(FILE.split("\n")) for _ in range(r.choice([0, 1, 30]))) for i in range(30)} | {99: FILE, 100: "\n".join(FILE * 300 for _ in range(2)), 101: ""}
    docs = spark.createDataFrame(list(files.items()), "document_id long, raw string")
    lines = docs.select("document_id", F.posexplode(F.split("raw", "\n")).alias("n", "line")).repartition(16)
    key = lambda df: sorted(tuple(x) for x in df.select("document_id", "section_index", *[F.coalesce(c, F.lit("-")) for c in (*markers.FIELDS, "text")]).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = key(markers.sections_of_lines(lines, ["n"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == key(markers.sections(docs)) and len(found) > 1000
    (tmp_path / "big.txt").write_text(files[100])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        read = markers.read_lines(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 5
        split = markers.sections_of_lines(read, ["block", "place"]).drop("document_id")
        whole = markers.sections(docs.where("document_id = 100")).drop("document_id")
        assert sorted(map(str, split.collect())) == sorted(map(str, whole.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_normal_forms_of_every_block(spark):
    """Signs of every range of 128 code points, alone and among others."""
    r, rows = random.Random(5), []
    for start in range(0x80, 0x110000, 128):
        signs = [chr(c) for c in r.sample(range(start, start + 128), 6) if not 0xD800 <= c < 0xE000]
        rows.append((start, f"Ab {''.join(signs)} ß-c_D"))
    rows += [(1, None), (2, ""), (3, "각 한글 ﷺ ½ ™ 𝔘𝔫𝔦 𝟙 ǅ ﬃ ẞ İı ς")]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).casefold()
    df = spark.createDataFrame(rows, "i long, t string")
    found = {x.i: (x.a, x.b) for x in df.select("i", text.strip_marks_whole(df.t).alias("a"), text.strip_marks(df.t).alias("b")).collect()}
    assert {i: v[0] for i, v in found.items()} == {i: None if t is None else plain(t) for i, t in rows}
    assert sum(v[0] != v[1] for v in found.values()) > 20  # what the columns alone don't reach
