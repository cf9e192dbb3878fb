"""Runs of words that repeat with a period, found by counting the matches at every lag.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical) and a length of at
least ``max(least, times * q)`` words that no neighbouring word extends with that period. A run of length ``L`` gives
``L - q`` matches in a row at lag ``q``, so only lags with ``max(least - q, (times - 1) * q)`` matches or more can have one.

Matches are counted exactly, at all lags of a text at once: for frequent words by the autocorrelation of the places
where they stand (one FFT each, summed before one inverse FFT, rounded to whole numbers), for rare ones by the
differences between pairs of places. Lags are then scanned from the smallest. A run of period ``p`` is also a stretch
of matches at each multiple of ``p``; those are taken off the counts, so that such lags are scanned only for other runs.

Texts are handled one by one within tasks of Spark; nothing meets in one task. Memory is in proportion to one text.
"""

from __future__ import annotations

from collections.abc import Iterator
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs of places whose differences are counted at a time, a bound on memory.
PAIRS = 1 << 20
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs string, runs_sha256 string, collapsed string, collapsed_sha256 string"


def lag_counts(ids: np.ndarray, lags: int, heavy: int | None = None) -> np.ndarray:
    """Number of places ``i`` with ``ids[i] == ids[i + q]``, for ``q`` from 0 to ``lags`` (at 0: 0).

    Words that occur more than ``heavy`` times are counted by FFT; by default where that costs less than their pairs.
    """
    n = len(ids)
    size = 1 << int(n + lags).bit_length()  # no lag up to ``lags`` wraps around
    heavy = int((8 * size * np.log2(size)) ** 0.5) if heavy is None else heavy
    often = np.bincount(ids)
    counts = np.zeros(lags + 1, np.int64)
    common = np.flatnonzero(often > heavy)
    if len(common):
        power = np.zeros(size // 2 + 1)
        for w in common:
            at = np.fft.rfft(ids == w, size)
            power += at.real**2 + at.imag**2
        counts += np.rint(np.fft.irfft(power, size)[: lags + 1]).astype(np.int64)
    places = np.flatnonzero(often[ids] <= heavy)
    places = places[np.argsort(ids[places], kind="stable")]  # by word, then by place
    word = ids[places]
    for k in range(1, int(often[often <= heavy].max(initial=0))):  # pairs of a word's occurrence and the k-th after it
        still = np.flatnonzero(word[k:] == word[:-k])
        for at in range(0, len(still), PAIRS):
            i = still[at : at + PAIRS]
            apart = places[i + k] - places[i]
            apart = apart[apart <= lags]
            if len(apart):
                found = np.bincount(apart)
                counts[: len(found)] += found
    counts[0] = 0
    return counts


def find_runs(ids: np.ndarray, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run, by start, then period."""
    n = len(ids)
    lags = n // times
    if n < least or not lags:
        return []
    counts = lag_counts(ids, lags)
    q = np.arange(lags + 1)
    enough = np.maximum(least - q, (times - 1) * q)
    enough[0] = n + 1
    runs, known = [], set()
    for lag in np.flatnonzero(counts >= enough):
        if counts[lag] < enough[lag]:  # runs of smaller periods account for these matches
            continue
        same = np.zeros(n - lag + 2, np.int8)
        same[1:-1] = ids[:-lag] == ids[lag:]
        edge = np.flatnonzero(np.diff(same))
        starts, ends = edge[::2], edge[1::2]
        long_ = ends - starts >= enough[lag]
        for s, e in zip(starts[long_].tolist(), ends[long_].tolist(), strict=True):
            length, period = e - s + int(lag), int(lag)
            if (s, length) in known:  # with a smaller period
                continue
            known.add((s, length))
            runs.append((s, length, period))
            multiples = np.arange(period, min(length - 1, lags) + 1, period)
            counts[multiples] -= length - multiples
    return sorted(runs, key=lambda r: (r[0], r[2]))


def _row(text: bytes | None, least: int, times: int) -> tuple:
    words = (text or b"").split()  # bytes are split at \x20 and \x09 to \x0D only
    runs = find_runs(pd.factorize(np.array(words, object))[0], least, times) if len(words) >= least else []
    keep = np.ones(len(words), bool)
    for s, length, q in runs:
        keep[s + q : s + length] = False
    best: tuple = (None,) * 4
    for s, length, q in runs:  # by start, then period: the first of equal ones stays
        if best[0] is None or length * best[2] > best[1] * q:
            best = (s, length, q, 1000 * length // q)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    collapsed = b" ".join(words if keep.all() else [w for w, k in zip(words, keep, strict=True) if k])
    return len(runs), *best, listed, hashlib.sha256(listed.encode()).hexdigest(), collapsed, hashlib.sha256(collapsed).hexdigest()


def detect(docs: DataFrame, least: int = 24, times: int = 3) -> DataFrame:
    """A row per row of ``docs`` (``doc_id``, ``text``, any more, which are left out).

    ``n_runs``; ``start`` (word number from 0), ``length``, ``period`` and ``exponent_milli`` of the run with the greatest
    length over period (ties: smallest start, then period); ``runs``: ``start,length,period`` of each, a line each;
    ``collapsed``: the words that are kept, joined by single spaces, where a run keeps its first period; and digests of both.

    Defined cases: a null, empty or blank text has no words, no runs and an empty ``collapsed``; no run gives nulls; a
    word that several runs hold goes if it is past the first period of any; repeated rows and null ids each give their
    row; an empty table gives an empty result. Texts are read whole, however long.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(x.as_py(), least, times) for x in batch.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 9
            kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.binary(), pa.string()]
            made = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs", "runs_sha256", "collapsed", "collapsed_sha256"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    found = rows.mapInArrow(task, RESULT.replace("collapsed string", "collapsed binary"))
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))
