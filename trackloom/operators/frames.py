"""Work on one frame at a time that no built-in function expresses, as a stream over sorted rows.

Rows are dealt by clip and frame and sorted inside a task, so a task holds one Arrow batch and what is
left of the frame at its end, never a clip and never a set of frames that grows with the table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Columns of one frame by name.
Frame = dict[str, np.ndarray]


def frames_of(batches: Iterator[pa.RecordBatch]) -> Iterator[Frame]:
    """Frame by frame out of rows sorted by clip and frame."""
    held: Frame | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
        if held is not None:
            rows = {c: np.concatenate([held[c], v]) for c, v in rows.items()}
        new = (rows["frame"][1:] != rows["frame"][:-1]) | (rows["clip"][1:] != rows["clip"][:-1])
        edges = [0, *(np.flatnonzero(new) + 1)]
        for a, b in zip(edges, edges[1:], strict=False):
            yield {c: v[a:b] for c, v in rows.items()}
        held = {c: v[edges[-1] :] for c, v in rows.items()}
    if held is not None:
        yield held


def by_frame(df: DataFrame, order: list[str], handle: Callable[[Frame], Frame], schema: str) -> DataFrame:
    """``handle`` for the rows of every (clip, frame), in ``order``; what it returns has the columns of ``schema``."""
    names = [c.split()[0] for c in schema.split(", ")]

    def packed(out: list[Frame]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]), from_pandas=True) for c in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[Frame] = []
        for f in frames_of(batches):
            out.append(handle(f))
            if len(out) == 1000:
                yield packed(out)
                out = []
        if out:
            yield packed(out)

    return df.repartition("clip", "frame").sortWithinPartitions("clip", "frame", *order).mapInArrow(run, schema)
