"""Periodic runs of words: heavy and light lag counting, then island scans.

A run is a stretch of consecutive words with smallest period q and at least ``max(24, 3 * q)`` words that neither
neighbour extends.  Words q apart are identical in it, so the run has ``length - q`` matches at lag q, and each of its words
occurs at least three times in the text.  Per text:

1. Matches are counted for every lag up to a third of the text, exactly.  Rare (light) words give the differences
   of their places, pair by pair.  Frequent (heavy) ones give the autocorrelation of their places by a fast Fourier
   transform, whose whole numbers are rounded back; the power spectra are summed, so there is one way back for all.
2. Lags are taken in rising order.  Matches inside known runs whose period divides the lag are subtracted, so the
   multiples of a period cost nothing.  A lag with too few matches left holds no run.
3. A run at a lag covers several neighbouring points of a coarse grid.  Only if they match, the lag's islands of matches are
   scanned over the whole text; an island is a run unless a shorter period divides its lag.

All work is within one row: no shuffle, and a lost executor repeats its texts.  Memory is a few arrays of the words of one text.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; repeated rows have equal
results; an empty table gives no rows; columns of the operator's names are replaced, others pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from .common import OWN, annotate

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Points of the coarse grid within the matches that a run must have.
GRID = 8
#: Values that one block of transforms holds at most, but for one word's own.
BLOCK = 1 << 22


def words_of(text: str | None) -> list[bytes]:
    """Maximal stretches without ASCII white space."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal for equal words."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int32, len(words))


def lag_matches(codes: np.ndarray, most: int) -> np.ndarray:
    """For each lag from 0 to ``most``, how many places hold a word that occurs three times or more and also stands that many places on."""
    counts = np.zeros(most + 1, np.int64)
    often = np.bincount(codes)
    size = 1 << (len(codes) + most).bit_length()  # no lag up to ``most`` wraps round
    heavy_from = max(LEAST_PERIODS, int((size * size.bit_length() / 4) ** 0.5))
    order = np.argsort(codes, kind="stable")
    n = often[codes[order]]
    light = order[(n >= LEAST_PERIODS) & (n < heavy_from)]
    word, here, step = codes[light], np.arange(len(light)), 0
    while len(here):
        step += 1
        here = here[here + step < len(light)]
        there = here + step
        same = word[there] == word[here]
        here, there = here[same], there[same]
        gap = light[there] - light[here]
        near = gap <= most  # farther pairs of a place have wider gaps
        here = here[near]
        counts += np.bincount(gap[near], minlength=most + 1)
    heavy = np.flatnonzero(often >= heavy_from)
    if len(heavy):
        rows, power = max(1, BLOCK // size), np.zeros(size // 2 + 1)
        for at in range(0, len(heavy), rows):
            shown = np.zeros((min(rows, len(heavy) - at), size))
            for k, w in enumerate(heavy[at : at + rows]):
                shown[k, np.flatnonzero(codes == w)] = 1
            spectrum = np.fft.rfft(shown)
            power += (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
        counts += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
    return counts


def prime_divisors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def _on_grid(codes: np.ndarray, lag: int, need: int) -> bool:
    """Whether a stretch of ``need`` matches at the lag can be anywhere: it covers so many points of the grid in a row."""
    step = max(1, need // GRID)
    same = codes[: len(codes) - lag : step] == codes[lag::step]
    rest = need // step
    total = np.concatenate(([0], np.cumsum(same)))
    return len(same) >= rest and bool((total[rest:] - total[:-rest] == rest).any())


def islands(codes: np.ndarray, lag: int, need: int) -> list[tuple[int, int]]:
    """(start, matches) of each maximal stretch of at least ``need`` matches at the lag."""
    same = np.concatenate(([0], codes[: len(codes) - lag] == codes[lag:], [0])).astype(np.int8)
    edge = np.diff(same)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return [(int(a), int(b - a)) for a, b in zip(first, last, strict=True) if b - a >= need]


def find_runs(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(codes)
    most = n // LEAST_PERIODS
    if n < LEAST_WORDS:
        return []
    left = lag_matches(codes, most)
    lags = np.arange(most + 1)
    needs = np.maximum(LEAST_WORDS - lags, (LEAST_PERIODS - 1) * lags)
    runs = []
    for lag in np.flatnonzero(left >= needs).tolist():
        need = int(needs[lag])
        if lag == 0 or left[lag] < need or not _on_grid(codes, lag, need):
            continue
        for start, matches in islands(codes, lag, need):
            unit = codes[start : start + lag]
            if any(np.array_equal(unit[lag // p :], unit[: lag - lag // p]) for p in prime_divisors(lag)):
                continue  # a run of the shorter period, found before
            length = matches + lag
            runs.append((start, length, lag))
            # its matches at multiples of the period are islands of their own while two whole multiples fit
            further = np.arange(lag, min(length // 2, most) + 1, lag)
            left[further] -= length - further
    return sorted(runs, key=lambda r: (r[0], r[2]))


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """False for each word that a run contains after its first period."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:n]) == 0


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS_DDL = "array<struct<start:bigint,length:bigint,period:bigint>>"
FOUND = pa.struct([("runs", pa.list_(RUN)), ("collapsed", pa.string())])


def runs_column(text: Column) -> Column:
    """Struct of ``runs`` and ``collapsed`` for each text (null: empty)."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, collapsed = [], []
            for value in batch:
                words = words_of(value.as_py())
                runs = find_runs(numbered(words))
                if runs:
                    words = [w for w, keep in zip(words, kept_words(len(words), runs).tolist(), strict=True) if keep]
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                collapsed.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.StructArray.from_arrays([pa.array(found, pa.list_(RUN)), pa.array(collapsed, pa.string())], fields=list(FOUND))

    return arrow_udf(run, f"runs {RUNS_DDL}, collapsed string", ArrowUDFType.SCALAR_ITER)(text)


def annotate_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``runs`` (start, length and period in words, by start, then period) and ``collapsed``: the text, its words joined by one space, without what repeats in runs."""
    return annotate(docs, runs_column(F.col(text)), ["runs", "collapsed"])


def planted(words: list[bytes], key: str) -> list[bytes]:
    """The words with a repeated tail, whose place and period follow from the key's checksum, for one key in ten."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def planted_column(key: Column, text: Column) -> Column:
    """Each text with the repeats that its key plants (null key: none)."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, values in batches:
            out = []
            for k, t in zip(keys, values, strict=True):
                k = k.as_py()
                # a text without repeats stays in the JVM
                out.append(None if k is None or zlib.crc32(k.encode()) % 10 else b" ".join(planted(words_of(t.as_py()), k)).decode("utf-8", "surrogatepass"))
            yield pa.array(out, pa.string())

    chosen = F.when(F.crc32(key) % 10 == 0, text)
    return F.coalesce(arrow_udf(run, "string", ArrowUDFType.SCALAR_ITER)(key, chosen), text)


def run_digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document of planted texts: run count, the run of greatest exponent, and hashes of all runs and of the collapsed text."""
    name = F.col(key).cast("string")
    made = annotate_runs(docs.select(F.col(key).alias(key), planted_column(name, F.col(text)).alias(OWN + "t")), OWN + "t")
    runs = F.col("runs")

    def better(a: Column, b: Column) -> Column:
        """Exact order of length / period, falling, then start and period."""
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (
            F.when(x > y, -1).when(x < y, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)
        )

    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.col(OWN + "best")
    return made.withColumn(OWN + "best", F.get(F.array_sort(runs, better), F.lit(0))).select(
        key,
        F.size(runs).cast("long").alias("n_runs"),
        best["start"].alias("start"),
        best["length"].alias("length"),
        best["period"].alias("period"),
        F.call_function("div", best["length"] * 1000, best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
