"""What Spark sends a Python task at a time is bounded in bytes."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evidentia.operators import batches, claims

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def unset(spark):
    before = spark.conf.get(SETTING)
    spark.conf.unset(SETTING)
    yield spark
    spark.conf.set(SETTING, before)


def largest(spark):
    """Bytes of the largest batch of 200 texts of 100,000 signs."""
    sizes = lambda found: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in found)
    return spark.range(200, numPartitions=1).select(F.repeat(F.lit("x"), 100_000).alias("t")).mapInArrow(sizes, "n long").agg(F.max("n")).first()[0]


def test_outputs_are_parsed_in_bounded_batches(unset):
    """whole answers go to the parser by bytes, not by ten thousand rows."""
    assert largest(unset) > 5 * batches.BATCH_BYTES
    claims.parse_outputs(unset.createDataFrame([(1, "a")], "query_id long, raw_output string"))
    assert largest(unset) < 2 * batches.BATCH_BYTES


def test_bracket_answers_are_parsed_in_bounded_batches(unset):
    """the query's answers, paragraph by paragraph, by the same bounded way."""
    from evidentia.plans import answers

    answers.bracket_answers(unset, "/root/testdata/sf0.001")
    assert largest(unset) < 2 * batches.BATCH_BYTES


def test_tokens_are_counted_in_bounded_batches(unset):
    """texts and their parts go to the counter by bytes."""
    from evidentia.functions import bpe

    bpe.counter()
    assert largest(unset) < 2 * batches.BATCH_BYTES
