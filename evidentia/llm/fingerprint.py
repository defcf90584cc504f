"""Document fingerprints by one-permutation MinHash.

The runs of a text's words are hashed once. The low bits of a hash choose one of `bins` bins, the others are its value; a bin
keeps its smallest value. An empty bin tries others in an order of its own, given by hashes of its number, and takes the value
of the first that isn't empty: each is equally likely, and two texts choose alike (optimal densification). Of each bin the lowest four bits are kept,
sixteen bins in a long. The share of equal bins, less what equal bits come by chance, estimates the Jaccard likeness.

All of it is expressions on arrays within a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.llm.common import materialize, small

WORD = r"[^\x20\x09-\x0D]+"
BITS = 4
#: Bins that an empty bin tries by hashes, before all are ranked for it.
PROBES = 8
_PER_LONG = 64 // BITS
#: Rows that a range of doc_ids should hold.
RANGE_ROWS = 20_000


def fingerprint(text: Column, shingle_words: int = 5, bins: int = 256) -> Column:
    """Array of bins / 16 longs; an empty array for a text without words. A text with fewer words is one run."""
    words = F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))
    return F.transform(F.array(words), lambda w: _pack(_densified(_smallest(_shingles(w, shingle_words), bins), bins), bins))[0]


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shingles(words: Column, size: int) -> Column:
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]))


def _smallest(hashes: Column, bins: int) -> Column:
    """Of each bin that isn't empty: its number in the top eight bits, its smallest value below."""
    keys = F.sort_array(F.transform(hashes, lambda h: F.shiftleft(h.bitwiseAND(F.lit(bins - 1).cast("long")), 56).bitwiseOR(F.shiftrightunsigned(h, 8))))
    return _let(keys, lambda x: F.filter(x, lambda k, i: (i == 0) | (F.shiftrightunsigned(k, 56) != F.shiftrightunsigned(F.get(x, i - 1), 56))))


def _densified(smallest: Column, bins: int) -> Column:
    """The lowest bits of all bins in order."""
    mask = F.lit((1 << BITS) - 1).cast("long")

    def fill(kept: Column) -> Column:
        numbers = F.transform(kept, lambda k: F.shiftrightunsigned(k, 56))

        def of_bin(own: Column, places: Column, b: Column) -> Column:
            # places: of each bin its place among those that aren't empty, from 1, or 0
            chosen = F.when(F.get(places, b.cast("int")) > 0, F.get(places, b.cast("int")))
            for i in range(PROBES):
                at = F.get(places, F.xxhash64(b, F.lit(i)).bitwiseAND(F.lit(bins - 1).cast("long")).cast("int"))
                chosen = chosen.when(at > 0, at)
            # none of the probes hit: the smallest hash of (empty bin, other bin) wins; its low byte is the other bin's place
            rank = F.array_min(F.transform(own, lambda n, i: F.xxhash64(b, n).bitwiseAND(F.lit(~255).cast("long")).bitwiseOR(i.cast("long"))))
            return F.get(kept, (chosen.otherwise(rank.bitwiseAND(F.lit(255).cast("long")) + 1) - 1).cast("int")).bitwiseAND(mask)

        every = F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))
        return _let(numbers, lambda own: _let(F.transform(every, lambda b: F.array_position(own, b)), lambda places: F.transform(every, lambda b: of_bin(own, places, b))))

    return _let(smallest, lambda kept: F.when(F.size(kept) > 0, fill(kept)).otherwise(F.array().cast("array<bigint>")))


def _pack(low: Column, bins: int) -> Column:
    def one(x: Column, j: Column) -> Column:
        return F.aggregate(F.slice(x, j * _PER_LONG + 1, _PER_LONG), F.lit(0).cast("long"), lambda acc, v: F.shiftleft(acc, BITS).bitwiseOR(v))

    return _let(low, lambda x: F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.lit(bins // _PER_LONG - 1)), lambda j: one(x, j))).otherwise(x))


def as_hex(packed: Column) -> Column:
    return F.array_join(F.transform(packed, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimate of the Jaccard likeness from two packed fingerprints, 0 to 1.

    Two empty fingerprints are alike, an empty and another one aren't.
    """
    ones = int("1" * _PER_LONG, 16)

    def differing(x: Column) -> Column:
        y = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        y = y.bitwiseOR(F.shiftrightunsigned(y, 2))
        return F.bit_count(y.bitwiseAND(F.lit(ones).cast("long")))

    unequal = F.aggregate(F.zip_with(a, b, lambda x, y: differing(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    chance = 2.0**-BITS
    share = 1 - unequal / (F.size(a) * _PER_LONG)
    estimate = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).when(F.size(a) == 0, F.lit(1.0)).otherwise(estimate)


def successors(ids: DataFrame) -> DataFrame:
    """For rows (doc_id, ...): also next_id, the next smaller doc_id; the largest after the smallest.

    Spark deals the rows out by ranges of doc_id of about RANGE_ROWS, however many there are. Within a range a window finds the
    next; the first of a range is the next of the last of the range above it, for which one row per range is enough.
    """
    n = ids.count()
    ranged = materialize(ids.repartitionByRange(max(1, -(-n // RANGE_ROWS)), "doc_id").withColumn("range", F.spark_partition_id()), "ranges")
    tops = ranged.groupBy("range").agg(F.max("doc_id").alias("top"))
    every = Window.orderBy(F.desc("range"))
    tops = tops.select("range", F.coalesce(F.lead("top").over(every), F.max("top").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("below"))
    inside = F.lead("doc_id").over(Window.partitionBy("range").orderBy(F.desc("doc_id")))
    return ranged.withColumn("next_id", inside).join(small(tops), "range").withColumn("next_id", F.coalesce("next_id", "below")).drop("range", "below")


def edited_fingerprints(docs: DataFrame, shingle_words: int = 5, bins: int = 256) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last third replaced by the beginning of the next document's text. A null text counts as empty; an
    empty text has the empty fingerprint; the only document of a table is its own next one. doc_id must be given and must not
    repeat (rows without one are left out). Only lengths and ids are sorted; of the next document only the part that is needed
    is shuffled to where it is needed.
    """
    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    order = materialize(successors(materialize(texts.select("doc_id", F.char_length("text").alias("n")), "lengths")), "order")
    own = texts.withColumn("fp", fingerprint(F.col("text"), shingle_words, bins)).repartition("doc_id")
    heads = own.withColumnRenamed("doc_id", "next_id").join(order, "next_id").select("doc_id", F.expr("left(text, n div 3)").alias("head"), F.col("fp").alias("next_fp"))
    both = own.join(heads, "doc_id").withColumn("n_chars", F.char_length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("left(text, cast(n_chars - n_chars div 3 as int))"), "head"))
    both = both.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fp", fingerprint(F.col("edited"), shingle_words, bins).alias("edited_fp"), "next_fp")
    return both.select("doc_id", "n_chars", "edited_sha256", as_hex(F.col("fp")).alias("fingerprint"), as_hex(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
