"""Assertions over streams: an extension, as validation of files has no streams.

Row-level assertions are stateless, so they run on a stream as on a table: a
windowed count of violations per rule, with a watermark for late rows, in one
pass over the events. Aggregates of whole tables have no meaning on an
unbounded input and are refused.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import checking, syntax
from ..operators import assertions


def violation_windows(stream: DataFrame, scope: checking.Scope, rules: dict[str, str], time: str, width: str = "5 minutes", late: str = "10 minutes", now: dt.datetime | None = None) -> DataFrame:
    """(window start, rule, rows, violations) per tumbling window; works on streams and on tables."""
    now = now or dt.datetime.now(dt.UTC).replace(tzinfo=None)
    counts = []
    for name, text in rules.items():
        typed = checking.check(syntax.parse(text), scope)
        if not typed.ok:
            raise ValueError(f"{name}: {'; '.join(f.message for f in typed.findings)}")
        prepared = assertions.prepare(typed, scope, stream.schema, now)
        if prepared.barrier:
            raise ValueError(f"{name}: {prepared.barrier}")
        if any(isinstance(n, syntax.Call) and n.name in checking.AGGREGATES for n in syntax.walk(typed.tree)):
            raise ValueError(f"{name}: a stream has no table aggregates")
        judged = assertions.judge(prepared, stream.schema, now, assertions.Folded())
        counts.append(F.count_if(judged.violated).alias(f"v_{name}"))
    instant = F.col(time).cast("timestamp")  # watermarks need an instant; the session is in UTC
    source = stream.withColumn("__time__", instant)
    if stream.isStreaming:
        source = source.withWatermark("__time__", late)
    windows = source.groupBy(F.window("__time__", width)).agg(F.count(F.lit(1)).alias("rows"), *counts)
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"v_{n}").alias("violations")) for n in rules])
    return windows.select(F.col("window.start").alias("start"), "rows", F.explode(pairs).alias("r")).select("start", "r.rule", "rows", "r.violations")
