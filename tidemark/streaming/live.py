"""Streams: windows closed at a boundary, and the causal filter carried on from batch to batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.hmm import GaussianHmm, log_density


def daily_items(stream: DataFrame, published: str = "published", source: str = "source", late: str = "1 day") -> DataFrame:
    """(day, source, n, first, last): items of each day and source; a day is final once the watermark has passed its end, and what comes later is dropped by Spark."""
    day = F.window(published, "1 day")
    return (
        stream.withWatermark(published, late)
        .groupBy(day.alias("w"), source)
        .agg(F.count("*").alias("n"), F.min(published).alias("first"), F.max(published).alias("last"))
        .select(F.to_date("w.start").alias("day"), source, "n", "first", "last")
    )


def live_filter(stream: DataFrame, models: dict[str, GaussianHmm], columns: Sequence[str], stressed: dict[str, int], key: str = "asset", order: str = "d") -> DataFrame:
    """(key, d, stressed_prob, state, late): filtered states of each new row, from a fitted model for each key. The state that is kept for a key is the vector of probabilities and
    the last day; a row that isn't after that day is marked late and changes nothing."""
    kind = stream.schema[order].dataType.simpleString()
    sent = stream.sparkSession.sparkContext.broadcast((models, stressed))

    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        models, stressed = sent.value
        rows = pd.concat(list(parts)).sort_values(order)
        model = models.get(keys[0])
        probs, last = (np.array(state.get[0]), state.get[1]) if state.exists else (None, None)
        out = []
        for row in rows.itertuples(index=False):
            day = getattr(row, order)
            stamp = pd.Timestamp(day).isoformat()
            late = last is not None and stamp <= last
            if model is not None and not late:
                dens = log_density(np.array([[float(getattr(row, c)) for c in columns]]), model.means, model.covs)[0]
                step = np.exp(dens - dens.max()) * (model.start if probs is None else probs @ model.move)
                probs, last = step / step.sum(), stamp
            p = float(probs[stressed[keys[0]]]) if probs is not None and not late else None
            out.append((keys[0], day, p, None if p is None else int(p >= 0.5), late))
        if probs is not None:
            state.update((probs.tolist(), last))
        yield pd.DataFrame(out, columns=[key, order, "stressed_prob", "state", "late"])

    return stream.groupBy(key).applyInPandasWithState(
        run, f"`{key}` {stream.schema[key].dataType.simpleString()}, `{order}` {kind}, stressed_prob double, state int, late boolean", "probs array<double>, last string", "append", GroupStateTimeout.NoTimeout
    )
