"""What fails is set aside: zero rows and an error row for a clip or a group, and everything else as if nothing had happened."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.sources.store import stored

ERRORS = "clip string, stage string, error string"
#: Halvings of the hash range of clips; clips that still share one are set aside together.
HALVINGS = 60


def first_line(e: BaseException) -> str:
    """The line of an error that says what has happened: the last one of a Python worker's trace, else the first."""
    lines = [x.strip() for x in str(e).splitlines() if x.strip()]
    named = [x for x in lines if x.partition(":")[0].endswith(("Error", "Exception")) and not x.startswith("at ")]
    return (named[-1] if named else lines[0] if lines else type(e).__name__)[:500]


def guarded_groups(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, stage: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of ``run`` for each group: a group that raises gives no rows and one error row (keys, stage, error)."""
    names = [c.split()[0] for c in schema.split(", ")]
    marks = [f"_key_{k}" for k in keys]

    def safely(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = run(pdf)[names]
            out = out.astype({c: object for c in names if isinstance(out[c].dtype, pd.StringDtype)})
            nothing = pd.Series(None, index=out.index, dtype=object)
            return out.assign(_error=nothing, **{m: nothing for m in marks})
        except Exception as e:  # any error of the group's own code ends up in the error table
            return pd.DataFrame([{**{m: pdf[k].iloc[0] for m, k in zip(marks, keys, strict=True)}, "_error": f"{type(e).__name__}: {e}"[:500]}], columns=[*names, "_error", *marks], dtype=object)

    kinds = ", ".join(f"{m} {df.schema[k].dataType.simpleString()}" for m, k in zip(marks, keys, strict=True))
    out = stored(df.groupBy(*keys).applyInPandas(safely, f"{schema}, _error string, {kinds}"), "guarded")
    errors = out.where("_error is not null").select(*[F.col(m).alias(k) for m, k in zip(marks, keys, strict=True)], F.lit(stage).alias("stage"), F.col("_error").alias("error"))
    return out.where("_error is null").select(*names), errors


def build_or_set_aside(df: DataFrame, build: Callable[[DataFrame], DataFrame], stage: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of ``build``, which treats clips apart, over all clips at once.

    Only when a job fails are the clips halved, by a hash, until the failing ones are alone: they give no rows and one error row
    each (clip, stage, error), so k of n clips cost some k log n jobs and none costs one. A plan that can't be
    analysed is nobody's data and raises.
    """
    spark = df.sparkSession
    place = F.shiftrightunsigned(F.xxhash64("clip"), 64 - HALVINGS)
    good: list[DataFrame] = []
    bad: list[tuple[str, str, str]] = []

    def attempt(low: int, high: int) -> None:
        part = df if (low, high) == (0, 1 << HALVINGS) else df.where((place >= low) & (place < high))
        try:
            good.append(stored(build(part), f"guarded-{stage}"))
            return
        except AnalysisException:
            raise
        except PySparkException as e:
            error = first_line(e)
        clips = [r.clip for r in part.select("clip").distinct().limit(2).collect()]
        if len(clips) > 1 and high - low > 1:
            middle = (low + high) // 2
            attempt(low, middle)
            attempt(middle, high)
        else:
            bad.extend((c, stage, error) for c in clips)

    attempt(0, 1 << HALVINGS)
    rows = good[0] if good else build(df.limit(0))
    for other in good[1:]:
        rows = rows.unionByName(other)
    return rows, spark.createDataFrame(bad, ERRORS)
