"""The URL frontier as a stream: the first sight of every URL, and polite start times that carry over batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls


def first_seen(stream: DataFrame) -> DataFrame:
    """(url, ts) rows with url_id and domain, each URL once ever; none is late, so the state keeps every url_id."""
    ids = stream.withColumn("url_id", urls.url_id(F.col("url"))).withColumn("domain", urls.host(F.col("url")))
    return ids.where("url_id IS NOT NULL").dropDuplicates(["url_id"])


def polite(stream: DataFrame, delay: float = 2.0) -> DataFrame:
    """Rows (domain, url_id, arrival) to start times; the state is each domain's next allowed time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        ready = state.get[0] if state.exists else float("-inf")
        rows = pd.concat(list(batches)).sort_values(["arrival", "url_id"])
        starts = []
        for at in rows["arrival"]:
            start = max(at, ready)
            ready = start + delay
            starts.append(start)
        state.update((ready,))
        yield pd.DataFrame({"domain": key[0], "url_id": rows["url_id"], "start": starts})

    return stream.groupBy("domain").applyInPandasWithState(
        step, "domain string, url_id string, start double", "ready double", "append", "NoTimeout"
    )
