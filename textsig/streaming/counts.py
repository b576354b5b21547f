"""Token and bit frequencies and sketches of streams of documents. All can be added up, so the order in which documents arrive doesn't matter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tok
from ..operators import matrices


def token_counts(docs: DataFrame, kind: str = "W") -> DataFrame:
    """value, n of a stream of documents (doc_id, text); for output mode complete or update."""
    return tok.counts(docs, kind)


def bit_counts(signatures: DataFrame) -> DataFrame:
    """bit, df of a stream of signatures (bits)."""
    return signatures.select(F.explode("bits").alias("bit")).groupBy("bit").agg(F.count("*").alias("df"))


def windowed_counts(events: DataFrame, time: str, keys: list[str], every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, keys, n by window, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, every).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "n")


class StreamedSketch:
    """A sketch of all signatures of a stream, for `foreachBatch`: each micro-batch is sketched by its tasks and merged into 2 * size rows of dim numbers that the
    driver holds. A batch that comes again (of the same number) is left out."""

    def __init__(self, bits: str, dim: int, size: int):
        self.bits, self.sketch, self.last = bits, matrices.Sketch(dim, size), -1

    def update(self, batch: DataFrame, number: int) -> None:
        if number > self.last:
            self.sketch.add(matrices.sketched(batch, self.bits, self.sketch.dim, self.sketch.size).rows)
            self.last = number

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(singular values, their rows) of what came so far; more may come after."""
        s = matrices.Sketch(self.sketch.dim, self.sketch.size)
        s.add(self.sketch.rows)
        return s.finish()
