"""Streams: event text, restoring tokens split over events, counters, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.providers import ChatAdapter
from ..sources.scratch import scratch_dir

#: No token is longer; text held back for an open bracket is bounded by it.
LONGEST_TOKEN = 64


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a streaming frame over all that is there and gives the result as a batch."""
    spark = df.sparkSession
    out = scratch_dir(spark, name)
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{out}/out").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{out}/out")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/out-{epoch}")
        last.append(epoch)

    last: list[int] = []
    q = df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/out-{last[-1]}")


def delta_text(events: DataFrame, body: str = "body") -> DataFrame:
    """Events with the text they add; stateless."""
    return events.withColumn("delta", ChatAdapter().delta_text(F.col(body)))


def request_counts(requests: DataFrame) -> DataFrame:
    """Requests so far by path, those answered with 404 included."""
    return requests.groupBy("path").agg(F.count("*").alias("n"))


def held_back(text: str) -> int:
    """Where the part begins that may be the start of a token."""
    at = text.rfind("[")
    return at if at >= 0 and "]" not in text[at:] and len(text) - at < LONGEST_TOKEN else len(text)


def _unmask(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    carry = state.get[0] if state.exists else ""
    rows = pd.concat(list(frames)).sort_values("seq")
    out = []
    for seq, delta, done, mapping in zip(rows["seq"], rows["delta"], rows["done"], rows["mapping"]):
        text = carry + (delta or "")
        at = len(text) if done else held_back(text)
        text, carry = text[:at], text[at:]
        for token, original in dict(mapping or {}).items():
            text = text.replace(token, original)
        out.append((key[0], seq, text))
    if rows["done"].any() and not carry:
        if state.exists:
            state.remove()
    else:
        state.update((carry,))
    yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])


def unmask(deltas: DataFrame, vault: DataFrame) -> DataFrame:
    """Deltas (stream_id, seq, delta, done) with tokens replaced by their originals from
    ``vault`` (stream_id, mapping), a token split over deltas included.  A stream's state goes
    with its ``done`` event; there is no timeout, as one in processing time keeps a run over
    all that is there from ending."""
    joined = deltas.join(vault, "stream_id", "left")
    return joined.groupBy("stream_id").applyInPandasWithState(_unmask, "stream_id long, seq int, text string", "carry string", "append", GroupStateTimeout.NoTimeout)


def rate_limited(requests: pd.DataFrame, tokens: float, at: float, rate: float, burst: float) -> tuple[list[bool], float, float]:
    """Token bucket over requests in time order: who passes, and the bucket after."""
    passed = []
    for t in requests["ts"]:
        tokens, at = min(burst, tokens + (t - at) * rate), t
        passed.append(tokens >= 1)
        tokens -= passed[-1]
    return passed, tokens, at


def rate_limit(requests: DataFrame, rate: float, burst: float) -> DataFrame:
    """(key, id, ts seconds) -> (key, id, passed) with one bucket per key."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        tokens, at = state.get if state.exists else (burst, float(rows["ts"].iloc[0]))
        passed, tokens, at = rate_limited(rows, tokens, at, rate, burst)
        state.update((float(tokens), float(at)))
        yield pd.DataFrame({"key": rows["key"], "id": rows["id"], "passed": passed})

    return requests.groupBy("key").applyInPandasWithState(run, "key long, id long, passed boolean", "tokens double, at double", "append", GroupStateTimeout.NoTimeout)
