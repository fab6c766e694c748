"""Passages repeated across documents, by sparse suffix arrays.

1. Suffixes start at minimisers: the smallest 8-gram hash of each window of ``WINDOW``. Two copies of a passage of
   ``LEAST`` words share a minimiser among its first ``WINDOW`` words, followed by ``CORE`` more words of the passage.
2. Suffixes with the same first ``CORE`` words in another text stay. Suffixes that meet in one slice of a map task are
   combined there, so a passage that many documents share sends one row per slice.
3. The suffixes left are sorted by their further words and compared with their neighbours, then the matches are
   extended left. Where that does not reach the full width, all ``LEAST``-word windows around the suffix are compared.
4. Groups of more than ``BIG`` suffixes (which bounds what a task holds) compare their windows by a Spark aggregation
   instead, after the texts of each slice have been compared among themselves.

Texts that are equal count as one; their documents repeat each other as a whole. Repeats inside one text alone are
not reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import _STEP, _Powers, grams, mix, raw, hash_words, slices
from plumbline.session import checkpoint

LEAST = 50
GRAM = 8
WINDOW = 24
CORE = LEAST - WINDOW + 1
#: Words beyond the core, on either side, that decide whether a window of LEAST words is shared.
SIDE = LEAST - CORE
BIG = 100_000

_U = np.uint64


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """Positions of the minimisers of one text that have a whole core to their right."""
    if len(hashes) < LEAST:
        return np.zeros(0, dtype=np.int64)
    runs = grams(hashes, GRAM)
    least = np.lib.stride_tricks.sliding_window_view(runs, WINDOW).argmin(axis=1)
    spots = np.unique(least + np.arange(len(least)))
    return spots[spots + CORE <= len(hashes)]


def cores(hashes: np.ndarray, spots: np.ndarray) -> np.ndarray:
    up, down = _Powers.to(len(hashes))
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[:len(hashes)], dtype=np.uint64, out=total[1:])
    return mix((total[spots + CORE] - total[spots]) * down[spots])


_KINDS = pa.schema([("doc_id", pa.int64()), ("tid", pa.int64()), ("n_words", pa.int32()), ("bucket", pa.int32()),
                    ("seeds", pa.binary()), ("tids", pa.binary()), ("spots", pa.binary()), ("times", pa.binary())])


def _scan(buckets: int):
    """One row per text (bucket null); packed suffixes per bucket; suffixes known to repeat in bucket -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tids = batch.column(1).to_pylist()
            for first, last, words in slices(batch.column(2)):
                rows, seeds, owner, spots = last - first, [], [], []
                for k, (a, b) in enumerate(zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True)):
                    tid = tids[first + k]
                    if b - a >= LEAST and tid not in seen:
                        seen.add(tid)
                        own = words.hashes[a:b]
                        at = minimisers(own)
                        seeds.append(cores(own, at))
                        owner.append(np.full(len(at), tid, dtype=np.int64))
                        spots.append(at.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows),
                     pa.array(np.diff(words.bounds).astype(np.int32)), *(pa.nulls(rows).cast(f.type) for f in list(_KINDS)[3:])], schema=_KINDS)
                if seeds:
                    yield _packed(buckets, *map(np.concatenate, (seeds, owner, spots)))
    return run


def _heads(keys: np.ndarray) -> np.ndarray:
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def _several(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For sorted keys, which rows have a key that more than one owner holds."""
    if not len(keys):
        return np.zeros(0, dtype=bool)
    heads = _heads(keys)
    mixed = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
    return np.repeat(mixed, np.diff(np.append(heads, len(keys))))


def _packed(buckets: int, seeds: np.ndarray, owner: np.ndarray, spots: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(seeds, kind="stable")
    seeds, owner, spots = seeds[order], owner[order], spots[order]
    known = _several(seeds, owner)
    heads = _heads(seeds)
    times = np.diff(np.append(heads, len(seeds))).astype(np.int32)
    #: One suffix stands for those of its seed in this slice if they repeat here; otherwise all of one text go.
    send = np.flatnonzero(~known)
    send = np.concatenate([send, heads[known[heads]]])
    weight = np.concatenate([np.ones(len(send) - int(known[heads].sum()), np.int32), times[known[heads]]])
    bucket = ((seeds[send] >> _U(33)) % _U(buckets)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    send, weight, bucket = send[order], weight[order], bucket[order]
    out = {f.name: [] for f in list(_KINDS)[3:]}

    def add(number: int, rows: np.ndarray, n: np.ndarray) -> None:
        for name, value in (("bucket", number), ("seeds", seeds[rows].tobytes()), ("tids", owner[rows].tobytes()),
                            ("spots", spots[rows].tobytes()), ("times", n.tobytes())):
            out[name].append(value)

    cuts = _heads(bucket) if len(bucket) else np.zeros(0, int)
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(send)], strict=True):
        add(int(bucket[a]), send[a:b], weight[a:b])
    if known.any():
        add(-1, np.flatnonzero(known), np.zeros(int(known.sum()), np.int32))
    return pa.RecordBatch.from_arrays(
        [*(pa.nulls(len(out["bucket"])).cast(f.type) for f in list(_KINDS)[:3]), *(pa.array(out[f.name], f.type) for f in list(_KINDS)[3:])],
        schema=_KINDS)


def _unpack(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    for seeds, tids, spots, times in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
        yield np.frombuffer(seeds, np.uint64), np.frombuffer(tids, np.int64), np.frombuffer(spots, np.int32), np.frombuffer(times, np.int32)


_OWN = "tid long, spots binary, seeds binary"


def _by_text(tids: np.ndarray, spots: np.ndarray, seeds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per text with its packed suffixes."""
    order = np.argsort(tids, kind="stable")
    tids, spots, seeds = tids[order], spots[order], seeds[order]
    heads = _heads(tids)
    spans = list(zip(heads.tolist(), [*heads[1:].tolist(), len(tids)], strict=True)) if len(tids) else []
    for at in range(0, len(spans), 10_000):
        some = spans[at:at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(tids[heads[at:at + 10_000]]), pa.array([spots[i:j].tobytes() for i, j in some], pa.binary()),
                                          pa.array([seeds[i:j].tobytes() for i, j in some], pa.binary())], names=["tid", "spots", "seeds"])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seeds, tids, spots, _ in _unpack(batch):
            yield from _by_text(tids, spots, seeds)


def _repeated(most: int):
    """Suffixes whose seed another text holds, per text; rows without a text hold the seeds of groups of over ``most`` suffixes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [p for batch in batches for p in _unpack(batch)]
        if not parts:
            return
        seeds, tids, spots, times = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(seeds, kind="stable")
        seeds, tids, spots, times = seeds[order], tids[order], spots[order], times[order]
        heads = _heads(seeds)
        total = np.add.reduceat(times.astype(np.int64), heads)
        big = seeds[heads[total > most]]
        stands = np.repeat(np.maximum.reduceat(times, heads) > 1, np.diff(np.append(heads, len(seeds))))
        keep = (_several(seeds, tids) | stands) & (times == 1)
        yield from _by_text(tids[keep], spots[keep], seeds[keep])
        if len(big):
            yield pa.RecordBatch.from_arrays([pa.nulls(1).cast(pa.int64()), pa.array([b""], pa.binary()), pa.array([big.tobytes()], pa.binary())],
                                             names=["tid", "spots", "seeds"])
    return run


def _sides(hashes: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """32-bit words left of the spots (nearest first) and right of the cores, and how many there are."""
    small = (hashes >> _U(32)).astype(np.uint32)
    step = np.arange(SIDE)
    left, right = spots[:, None] - 1 - step, spots[:, None] + CORE + step
    n_left = np.minimum(spots, SIDE)
    n_right = np.minimum(len(small) - CORE - spots, SIDE)
    return (np.where(left >= 0, small[np.maximum(left, 0)], 0).astype(np.uint32), n_left,
            np.where(right < len(small), small[np.minimum(right, len(small) - 1)], 0).astype(np.uint32), n_right)


def _window_hashes(seeds, left, n_left, right, n_right) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of words to the left: which suffixes have such a window of LEAST words, and its hash."""
    n = len(seeds)
    a, b = np.zeros((SIDE + 1, n), dtype=np.uint64), np.zeros((SIDE + 1, n), dtype=np.uint64)
    for k in range(SIDE):
        a[k + 1] = a[k] * _STEP + left[:, k] + _U(1)
        b[k + 1] = b[k] * _STEP + right[:, k] + _U(1)
    for o in range(SIDE + 1):
        yield o, np.flatnonzero((n_left >= o) & (n_right >= SIDE - o)), mix(seeds + mix(a[o] + _U(o)) + mix(b[SIDE - o]) * _STEP)


def _own(packed: list[dict[str, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Spots and seeds of one text; tasks that met copies of it may have sent the same ones."""
    spots = np.concatenate([np.frombuffer(x["spots"], np.int32) for x in packed]).astype(np.int64)
    spots, at = np.unique(spots, return_index=True)
    return spots, np.concatenate([np.frombuffer(x["seeds"], np.uint64) for x in packed])[at]


def _records(batch: pa.RecordBatch, hubs: np.ndarray, big: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, tuple[np.ndarray, ...]]]:
    """(tid, spots, seeds, sides) of each text, for suffixes of big groups or of the others."""
    for i, tid in enumerate(batch.column(0).to_pylist()):
        spots, seeds = _own(batch.column(1)[i].as_py())
        mine = np.isin(seeds, hubs) == big
        if mine.any():
            hashes = hash_words(*raw(batch.column(2).slice(i, 1))).hashes
            yield tid, spots[mine], seeds[mine], _sides(hashes, spots[mine])


def _gathered(batches: Iterator[pa.RecordBatch], hubs: np.ndarray, big: bool) -> Iterator[list[np.ndarray]]:
    """Seeds, tids, spots and sides of the suffixes of some texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            got = list(_records(batch.slice(at, 500), hubs, big))
            if got:
                yield [np.concatenate([s for _, _, s, _ in got]), np.concatenate([np.full(len(p), t, dtype=np.int64) for t, p, *_ in got]),
                       np.concatenate([p.astype(np.int32) for _, p, *_ in got]), *(np.concatenate([x[k] for *_, x in got]) for k in range(4))]


def _send(buckets: int, hubs: np.ndarray):
    """Packed suffixes with their sides, per bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fields in _gathered(batches, hubs, False):
            fields[4], fields[6] = fields[4].astype(np.int8), fields[6].astype(np.int8)
            bucket = ((fields[0] >> _U(33)) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = _heads(bucket[order])
            spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[order[a]]) for a, _ in spans], pa.int32()),
                 *(pa.array([f[order[a:b]].tobytes() for a, b in spans], pa.binary()) for f in fields)],
                names=["bucket", "seeds", "tids", "spots", "left", "n_left", "right", "n_right"])
    return run


_SENT = "bucket int, seeds binary, tids binary, spots binary, left binary, n_left binary, right binary, n_right binary"
_SPAN = "tid long, low int, high int"


def _common(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Length of the common beginning of two rows of words, at most n."""
    return np.minimum(np.where((x != y).any(axis=1), (x != y).argmax(axis=1), SIDE), n)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of at least LEAST words that another text repeats."""
    parts: list[list[np.ndarray]] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seeds, tids, spots = (np.frombuffer(x, t) for x, t in zip(row[:3], (np.uint64, np.int64, np.int32), strict=True))
            parts.append([seeds, tids, spots, np.frombuffer(row[3], np.uint32).reshape(-1, SIDE), np.frombuffer(row[4], np.int8),
                          np.frombuffer(row[5], np.uint32).reshape(-1, SIDE), np.frombuffer(row[6], np.int8)])
    if not parts:
        return
    seeds, tids, spots, left, n_left, right, n_right = (np.concatenate(x) for x in zip(*parts, strict=True))
    parts.clear()
    # The suffix array: sorted by seed, then by the words that follow.
    order = np.lexsort((*(right[:, k] for k in range(SIDE - 1, -1, -1)), seeds))
    seeds, tids, spots, left, n_left, right, n_right = (x[order] for x in (seeds, tids, spots, left, n_left, right, n_right))
    before, after = np.full(len(seeds), -1), np.full(len(seeds), -1)
    if len(seeds) > 1:
        same = (seeds[1:] == seeds[:-1]) & (tids[1:] != tids[:-1])
        more = _common(right[1:], right[:-1], np.minimum(n_right[1:], n_right[:-1]))
        back = _common(left[1:], left[:-1], np.minimum(n_left[1:], n_left[:-1]))
        good = same & (more + back >= SIDE)
        for rows in (slice(1, None), slice(None, -1)):
            before[rows] = np.where(good, np.maximum(before[rows], back), before[rows])
            after[rows] = np.where(good, np.maximum(after[rows], more), after[rows])
    # Suffixes whose match is not as wide as it can be may match others more widely: compare their groups' windows.
    narrow = (before < n_left) | (after < n_right)
    heads = _heads(seeds)
    rest = np.flatnonzero(np.repeat(np.logical_or.reduceat(narrow, heads), np.diff(np.append(heads, len(seeds)))))
    for o, have, keys in _window_hashes(seeds[rest], left[rest], n_left[rest], right[rest], n_right[rest]):
        rows, keys = rest[have], keys[have]
        order = np.argsort(keys, kind="stable")
        rows = rows[order][_several(keys[order], tids[rows[order]])]
        before[rows] = np.maximum(before[rows], o)
        after[rows] = np.maximum(after[rows], SIDE - o)
    found = np.flatnonzero(before >= 0)
    for a in range(0, len(found), 100_000):
        at = found[a:a + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(tids[at]), pa.array((spots[at] - before[at]).astype(np.int32)),
                                          pa.array((spots[at] + CORE + after[at]).astype(np.int32))], names=["tid", "low", "high"])


def _windows(hubs: np.ndarray):
    """Of big groups: spans that repeat among these texts (window null), and windows that reach beyond them."""
    def rows(window, tids, low, high) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(window, pa.int64()), pa.array(tids), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32))],
                                          names=["window", "tid", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seeds, tids, spots, *sides in _gathered(batches, hubs, True):
            before, after = np.full(len(seeds), -1), np.full(len(seeds), -1)
            windows = [(o, have, keys[have]) for o, have, keys in _window_hashes(seeds, *sides)]
            for o, have, keys in windows:
                order = np.argsort(keys, kind="stable")
                again = have[order][_several(keys[order], tids[have[order]])]
                before[again] = np.maximum(before[again], o)
                after[again] = np.maximum(after[again], SIDE - o)
            found = np.flatnonzero(before >= 0)
            yield rows([None] * len(found), tids[found], spots[found] - before[found], spots[found] + CORE + after[found])
            for o, have, keys in windows:
                beyond = (o > before[have]) | (SIDE - o > after[have])
                low = spots[have[beyond]] - o
                yield rows(keys[beyond].view(np.int64), tids[have[beyond]], low, low + LEAST)
            # One window stands for those settled here, so that suffixes of other tasks meet it.
            for o, have, keys in windows:
                settled = have[(o <= before[have]) & (SIDE - o <= after[have])]
                keep = np.isin(have, settled)
                own, at = np.unique(keys[keep], return_index=True)
                low = spots[have[keep][at]] - o
                yield rows(own.view(np.int64), tids[have[keep][at]], low, low + LEAST)
    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of each text, joined where they overlap or touch."""
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            own: list[list[int]] = []
            for span in sorted((s["low"], s["high"]) for s in spans):
                if own and span[0] <= own[-1][1]:
                    own[-1][1] = max(own[-1][1], span[1])
                else:
                    own.append(list(span))
            out.append([{"first": a, "end": b} for a, b in own])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())])))],
                                         names=["tid", "spans"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_repeated, spans)`` of the rows of ``docs(doc_id, text)`` that hold repeated passages.

    ``spans`` are ranges of words [first, end), in order and apart, of all runs of at least ``LEAST`` words that also
    stand in another row, be it a copy or not. Words are cut at white space and compared in lower case. Null, empty
    and shorter texts hold none; a null ``doc_id`` is reported as null; rows that repeat a row repeat each other.
    """
    spark = docs.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    mine = docs.select("doc_id", F.xxhash64("text").alias("tid"), "text")
    scanned = checkpoint(mine.mapInArrow(_scan(buckets), "doc_id long, tid long, n_words int, bucket int, seeds binary, tids binary, spots binary, times binary"))
    rows = scanned.where("bucket is null and n_words >= {}".format(LEAST)).select("doc_id", "tid", "n_words")
    fields = ("seeds", "tids", "spots", "times")
    met = checkpoint(scanned.where("bucket >= 0").repartition("bucket").select(*fields).mapInArrow(_repeated(BIG), _OWN)
                     .unionByName(scanned.where("bucket = -1").select(*fields).mapInArrow(_known, _OWN)))
    # There is at most one such seed for BIG suffixes.
    hubs = np.frombuffer(b"".join(bytes(r.seeds) for r in met.where("tid is null").select("seeds").collect()), np.uint64)
    spots = met.where("tid is not null").groupBy("tid").agg(F.collect_set(F.struct("spots", "seeds")).alias("own"))
    none = F.lit(-(1 << 62))
    copies = rows.groupBy("tid").agg(F.min(F.coalesce("doc_id", none)).alias("id"), F.count("*").alias("copies"), F.max("n_words").alias("n"))
    wanted = spots.join(copies.select("tid", "id"), "tid")
    texts = checkpoint(mine.withColumn("id", F.coalesce("doc_id", none)).join(wanted, ["tid", "id"]).select("tid", "own", "text"))

    spans = (texts.mapInArrow(_send(buckets, hubs), _SENT).repartition("bucket").drop("bucket").mapInArrow(_matched, _SPAN))
    windows = checkpoint((texts if len(hubs) else texts.limit(0)).mapInArrow(_windows(hubs), "window long, tid long, low int, high int"))
    often = windows.where("window is not null").groupBy("window").agg(F.min("tid").alias("a"), F.max("tid").alias("b")).where("a <> b").select("window")
    spans = (spans.unionByName(windows.where("window is null").select("tid", "low", "high"))
             .unionByName(windows.join(often, "window").select("tid", "low", "high")))
    whole = copies.where("copies > 1").select("tid", F.lit(0).alias("low"), F.col("n").alias("high"))
    merged = (spans.unionByName(whole).groupBy("tid").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
              .mapInArrow(_merged, "tid long, spans array<struct<first:int,end:int>>"))
    length = F.aggregate("spans", F.lit(0), lambda total, s: total + s.end - s.first)
    return rows.join(merged, "tid").select("doc_id", "n_words", length.alias("n_repeated"), "spans")
