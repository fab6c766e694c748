"""Packing documents into batches of like length.

Documents are cut into pieces of at most ``longest`` tokens. Dynamic programming over the histogram of all piece
lengths chooses the bucket boundaries that minimise padding; inside each bucket pieces form batches of at most
``budget`` tokens, padding included. DataFrame functions only; the driver sees one count per length.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.session import checkpoint

LONGEST = 4096
BUCKETS = 16
BUDGET = 65536
#: Rows, about, of one length that one task numbers.
SHARD_ROWS = 100_000


def word_count() -> Column:
    """The default length of a text: its runs of characters other than white space."""
    return F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0))


def boundaries(lengths: list[int], counts: list[int], buckets: int = BUCKETS) -> list[int]:
    """Rising upper bounds of at most ``buckets`` buckets with the least padding; the last is the largest length.

    ``lengths`` rise and have no repeats. Among plans of equal padding the one with fewer buckets wins, then the one
    with smaller lower bounds.
    """
    m = len(lengths)
    if not m:
        return []
    size = np.array(lengths, dtype=np.int64)
    number, tokens = np.cumsum([0, *counts]), np.cumsum([0, *(a * b for a, b in zip(lengths, counts, strict=True))])
    best, back = [], []
    for b in range(min(buckets, m)):
        cost, source = np.zeros(m, dtype=np.int64), np.zeros(m, dtype=np.int64)
        for j in range(m):
            if b == 0:
                cost[j] = size[j] * number[j + 1] - tokens[j + 1]
                continue
            # The bucket of j begins after i < j; none before it counts as i = -1.
            pad = size[j] * (number[j + 1] - number[1:j + 1]) - (tokens[j + 1] - tokens[1:j + 1])
            total = best[-1][:j] + pad
            whole = size[j] * number[j + 1] - tokens[j + 1]
            k = int(total.argmin()) if j else -1
            cost[j], source[j] = (total[k], k) if j and total[k] < whole else (whole, -1)
        best.append(cost)
        back.append(source)
    b = int(np.argmin([cost[-1] for cost in best]))
    out, j = [], m - 1
    while j >= 0:
        out.append(lengths[j])
        j = int(back[b][j]) if b > 0 else -1
        b -= 1
    return out[::-1]


def pack(docs: DataFrame, length: Column | None = None, longest: int = LONGEST, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """``(doc_id, piece, first_token, n_tokens, bucket_tokens, batch)``, one row per piece of ``docs(doc_id, text)``.

    ``length`` is the number of tokens of a row, words unless given. ``batch`` numbers the batches of a bucket from 0;
    a batch has ``budget`` // ``bucket_tokens`` pieces (one at least), in order of length, the last of a bucket fewer. A
    row without tokens (null or empty text) gives one row with 0 tokens and neither bucket nor batch. Null ids and
    repeated rows are packed like others.
    """
    tokens = (word_count() if length is None else length).cast("long")
    counted = docs.select("doc_id", F.xxhash64("text").alias("tid"), tokens.alias("tokens"))
    pieces = counted.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("tokens") / longest) - 1, F.lit(0).cast("long")))))
    pieces = pieces.select("doc_id", "tid", F.col("piece").cast("int").alias("piece"), (F.col("piece") * longest).alias("first_token"),
                           F.least(F.lit(longest).cast("long"), F.col("tokens") - F.col("piece") * longest).cast("int").alias("n_tokens"))
    pieces = checkpoint(pieces)
    histogram = {r.n_tokens: r.n for r in pieces.where("n_tokens > 0").groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    lengths = sorted(histogram)
    tops = boundaries(lengths, [histogram[x] for x in lengths], buckets)
    starts, offset = [], 0
    for k, x in enumerate(lengths):
        top = tops[bisect_left(tops, x)]
        offset = 0 if not k or top != starts[-1][1] else offset + histogram[lengths[k - 1]]
        starts.append((x, top, offset))
    # One row per length, so at most ``longest`` rows.
    placed = F.broadcast(docs.sparkSession.createDataFrame(starts, "n_tokens int, bucket_tokens int, start long"))

    shards = max(1, math.ceil(sum(histogram.values()) / SHARD_ROWS))
    sharded = pieces.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "tid"), F.lit(shards)))
    sizes = sharded.groupBy("n_tokens", "shard").agg(F.count("*").alias("rows"))
    ahead = sizes.withColumn("ahead", F.coalesce(F.sum("rows").over(
        Window.partitionBy("n_tokens").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows")
    order = Window.partitionBy("n_tokens", "shard").orderBy("doc_id", "piece", "tid")
    numbered = (sharded.withColumn("place", F.row_number().over(order) - 1).join(ahead, ["n_tokens", "shard"])
                .join(placed, "n_tokens"))
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("bucket_tokens")))
    columns = ["doc_id", "piece", "first_token", "n_tokens", "bucket_tokens", "batch"]
    packed = numbered.withColumn("batch", F.floor((F.col("start") + F.col("ahead") + F.col("place")) / per_batch).cast("long"))
    empty = pieces.where("n_tokens <= 0").select("*", F.lit(None).cast("int").alias("bucket_tokens"), F.lit(None).cast("long").alias("batch"))
    return packed.select(*columns).unionByName(empty.select(*columns))
