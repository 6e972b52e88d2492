"""What the driver gets of a sketch is bounded, however many tasks count."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldtally.llm import near_text


def texts(spark, tasks):
    """600 texts of 300 words in ``tasks`` partitions, some alike, and some without words."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(300)), lambda i: F.pmod(F.xxhash64(F.pmod("id", F.lit(450)), i), F.lit(5000)).cast("string")))
    return spark.range(0, 600, 1, tasks).select(F.when(F.col("id") % 97 == 0, None).when(F.col("id") % 89 == 0, " ").otherwise(words).alias("text"))


def plainly(nodes):
    """Shingles counted by cell, one text after the other."""
    cells = np.zeros(near_text.SKETCH, np.int64)
    for r in nodes.collect():
        for h in near_text.shingle_sets(pa.array([r["text"]], pa.string()))[0]:
            cells[int(h) >> (64 - 17)] += 1
    return cells


def test_sketch_reaches_the_driver_once(spark, monkeypatch):
    """All tasks' cells together are as large as one sketch on the driver, and come in small rows."""
    nodes = texts(spark, 24)
    wanted, sizes = plainly(nodes), []

    def collect(df, gather=type(nodes).collect):
        out = gather(df)
        sizes.extend(len(r["cells"]) for r in out)
        return out

    monkeypatch.setattr(type(nodes), "collect", collect)
    found = near_text.counted(nodes)
    assert wanted.sum() > 100_000 and found.shape == wanted.shape and (found == wanted).all()
    assert sum(sizes) <= 8 * near_text.SKETCH and max(sizes) <= 1 << 16


def test_sketch_does_not_depend_on_tasks(spark):
    assert (near_text.counted(texts(spark, 1)) == near_text.counted(texts(spark, 7))).all()


def test_sketch_of_nothing(spark):
    for nodes in (texts(spark, 3).where("text = ' '"), texts(spark, 3).where("text = 'none'")):
        assert near_text.counted(nodes).shape == (near_text.SKETCH,) and not near_text.counted(nodes).any()
