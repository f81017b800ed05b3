"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is over the bytes of UTF-8 (order 5 by default, with a mark that no text holds before each text), so its
tables suit every language in one model, and an n-gram is a long: its context is the value shifted by a
byte, its suffix the value under a mask.  All counts, continuation counts, discounts and back-off weights
are DataFrame aggregations and joins over all trusted text.

Scoring reads each text once.  Tasks cut their documents into chunks of bounded size and write, for each
chunk, its distinct n-grams and its rows, compressed in parts, in buckets of the chunk's key.  The n-grams are joined with the
count tables, sharded by n-gram, and the resulting log probabilities meet the stored chunk again in its bucket; the
texts themselves are never shuffled.  The n-grams gathered grow with the chunks and so with the input.

A document is kept unless its perplexity (per byte) is above the given quantile of trusted documents of its
language (of all of them, where a language has none).  The quantiles are taken over the fifth of
trusted documents (by a hash of the id) that the counts leave out, as a text's own counts would
make its perplexity too low.  A perplexity equal to the threshold is kept.

Defined results: null and empty texts have no perplexity and are not kept; a null ``lang`` is a
language of its own; a label whose id is null or unknown is ignored; repeated rows get equal results; with no
trusted text at all the model is uniform, there is no threshold, and every text with a byte is kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import stage, stage_bucketed
from .common import OWN, small_batches

ORDER, QUANTILE, FOLDS = 5, 0.99, 5
#: Bytes of text in a chunk and in one of its parts (a longer text is a part of its own), and n-grams that are handled at once.
CHUNK_BYTES, PART_BYTES, BLOCK = 16_000_000, 1 << 21, 1 << 20
#: Buckets of the stored chunks, at most; a bucket holds several chunks beyond it, one after the other.
MOST_BUCKETS = 16_384
#: Trusted ids are broadcast up to so many, and joined by shuffle beyond.
BROADCAST_IDS = 1_000_000
#: A byte that UTF-8 never has.
PAD = 0xFF


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and the bounds of each text (null: empty)."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


class Padded:
    """Texts in one row of bytes, each after ``order - 1`` marks; n-grams are named by where they start."""

    def __init__(self, column: pa.Array, order: int):
        data, bounds = _bytes_of(column)
        self.order, lead = order, order - 1
        self.row = np.full(len(data) + lead * (len(bounds) - 1) + 8, PAD, np.uint8)
        #: Where the n-grams of each text start; only marks lie between the last one and the next text's first.
        self.starts = bounds[:-1] + lead * np.arange(len(bounds) - 1)
        for at, a, b in zip(self.starts.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            self.row[at + lead : at + lead + b - a] = data[a:b]
        self.size = len(data) + lead * (len(bounds) - 1) - lead if len(bounds) > 1 else 0

    def blocks(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(start, codes, whether each is an n-gram, as one that ends in a mark is not) of runs of n-grams."""
        for a in range(0, self.size, BLOCK):
            n = min(BLOCK, self.size - a)
            wide = np.ndarray((n,), ">u8", self.row, offset=a, strides=(1,))
            codes = (wide >> np.uint64(64 - 8 * self.order)).astype(np.int64)
            yield a, codes, self.row[a + self.order - 1 : a + self.order - 1 + n] != PAD


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their counts."""
    codes, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(codes, kind="stable")
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(codes)), bool), codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first) if len(first) else counts


def count_ngrams(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """(g, c): all n-grams of the only column with their counts, added up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        held = [none]

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(held)], ["g", "c"])

        for batch in batches:
            for _, codes, real in Padded(batch.column(0), order).blocks():
                held.append(np.unique(codes[real], return_counts=True))
                if sum(len(c) for c, _ in held) > 2_000_000:
                    held = [_merged(held)]
                    if len(held[0][0]) > 1_000_000:
                        yield flush()
                        held = [none]
        yield flush()

    return texts.mapInArrow(run, "g bigint, c bigint").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(row) -> tuple[float, float, float]:
    n1, n2, n3, n4 = (float(row[k] or 0) for k in range(4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def _suffix(g: str | Column, n: int) -> Column:
    """The last ``n`` bytes of an n-gram."""
    return (F.col(g) if isinstance(g, str) else g).bitwiseAND(F.lit((1 << 8 * n) - 1))


def _bounded(df: DataFrame, n: int) -> DataFrame:
    """A table of n-grams of ``n`` bytes, broadcast where their number is bounded by 65,536."""
    return F.broadcast(df) if n <= 2 else df


class Model:
    """Tables of one model: probabilities of known n-grams and back-off weights of known contexts, by order."""

    def __init__(self, counts: DataFrame, order: int = ORDER):
        if not 3 <= order <= 7:
            raise ValueError("an order of 3 to 7 bytes fits a long")
        self.order = order
        with small_batches(counts.sparkSession):
            by_order = {order: stage(counts, "ngrams")}
        for n in range(order - 1, 0, -1):
            by_order[n] = stage(by_order[n + 1].groupBy(_suffix("g", n).alias("g")).agg(F.count("*").alias("c")), "ngrams")
        self.floor = 1.0 / (by_order[1].count() + 1)
        self.known: dict[int, DataFrame] = {}
        self.back: dict[int, DataFrame] = {}
        for n in range(1, order + 1):
            c, g = F.col("c"), F.col("g")
            d1, d2, d3 = _discounts(by_order[n].agg(*[F.count_if(c == k) for k in (1, 2, 3, 4)]).first())
            cut = F.when(c == 1, d1).when(c == 2, d2).otherwise(d3)
            context = F.shiftright(g, 8)
            self.back[n] = stage(
                by_order[n].groupBy(context.alias("h")).agg(F.sum("c").alias("total"), F.sum(cut).alias("freed")).withColumn("gamma", F.col("freed") / F.col("total")), "contexts"
            )
            rows = by_order[n].withColumn("h", context).join(_bounded(self.back[n], n - 1), "h").withColumn("own", (c - cut) / F.col("total"))
            if n == 1:
                made = rows.withColumn("p", F.col("own") + F.col("gamma") * self.floor)
            else:
                lower = _bounded(self.known[n - 1].select(F.col("g").alias("s"), F.col("p").alias("q")), n - 1)
                made = rows.withColumn("s", _suffix(g, n - 1)).join(lower, "s").withColumn("p", F.col("own") + F.col("gamma") * F.col("q"))
            self.known[n] = stage(made.select("g", "p"), "probabilities")

    def log_probabilities(self, wanted: DataFrame) -> DataFrame:
        """(g, lp) for the distinct n-grams of ``wanted``, by joins with the tables of each order.

        An n-gram that an order knows is done; only the others go on to the next lower order, with the
        weight that backing off has cost so far.  The tables below order 3 have 65,536 rows at most.
        """
        open_ = wanted.select("g").distinct().withColumn("w", F.lit(1.0))
        done: list[DataFrame] = []
        for n in range(self.order, 2, -1):
            met = open_.withColumn("k", _suffix("g", n)).join(self.known[n].select(F.col("g").alias("k"), "p"), "k", "left")
            met = stage(met.select("g", "w", F.shiftright("k", 8).alias("h"), "p"), "looked_up")
            done.append(met.where("p is not null").select("g", (F.col("w") * F.col("p")).alias("p")))
            open_ = met.where("p is null").drop("p").join(_bounded(self.back[n].select("h", "gamma"), n - 1), "h", "left")
            open_ = open_.select("g", (F.col("w") * F.coalesce("gamma", F.lit(1.0))).alias("w"))
        two, one = (F.broadcast(self.known[n].select(F.col("g").alias(f"k{n}"), F.col("p").alias(f"p{n}"))) for n in (2, 1))
        back, top = F.broadcast(self.back[2].select("h", "gamma")), self.back[1].first()
        last = open_.withColumns({"k2": _suffix("g", 2), "k1": _suffix("g", 1), "h": F.shiftright(_suffix("g", 2), 8)})
        last = last.join(two, "k2", "left").join(back, "h", "left").join(one, "k1", "left")
        unknown = self.floor * (top["gamma"] if top else 1.0)
        p = F.coalesce("p2", F.coalesce("gamma", F.lit(1.0)) * F.coalesce("p1", F.lit(unknown)))
        every = last.select("g", (F.col("w") * p).alias("p"))
        for part in done:
            every = every.unionByName(part)
        return every.select("g", F.log("p").cast("float").alias("lp"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Consecutive rows (text last) of ``PART_BYTES`` or just over; no row is cut."""
    for batch in batches:
        _, bounds = _bytes_of(batch.column(batch.num_columns - 1))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(min(np.searchsorted(bounds, bounds[start] + PART_BYTES), batch.num_rows)))
            yield pa.Table.from_batches([batch.slice(start, end - start)])
            start = end


def _last(table: pa.Table) -> pa.Array:
    return pa.concat_arrays([c.cast(pa.large_string()) for c in table.column(table.num_columns - 1).chunks] or [pa.array([], pa.large_string())])


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 4))) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _positions(codes: np.ndarray):
    """A function that finds the place of codes, all of which are in ``codes`` (distinct and in order)."""
    bits = max(4, len(codes).bit_length() + 3)

    def slot(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)

    table = np.zeros(1 << bits, np.int32)
    table[slot(codes)] = np.arange(len(codes), dtype=np.int32)

    def find(x: np.ndarray) -> np.ndarray:
        at = table[slot(x)]
        other = np.flatnonzero(codes[at] != x)  # those whose slot another code has taken
        at[other] = np.searchsorted(codes, x[other])
        return at

    return find


def score(docs: DataFrame, model: Model, text: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The other columns of ``docs`` with ``n`` (bytes) and ``nll`` (sum of negative log probabilities)."""
    others, order, spark = [c for c in docs.columns if c != text], model.order, docs.sparkSession
    rows = docs.select(*others, text)
    kept_schema = docs.select(*others).schema

    def packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, seen = 0, 0, []

        def row(codes: np.ndarray | None, pack: bytes | None) -> pa.RecordBatch:
            lists = pa.array([None], pa.list_(pa.int64())) if codes is None else pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.array(codes))
            return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), lists, pa.array([pack], pa.binary())], ["chunk", "codes", "pack"])

        for part in _parts(batches):
            if not seen:
                key, size, seen = int.from_bytes(os.urandom(8), "little", signed=True), 0, [np.empty(0, np.int64)]
            texts = Padded(_last(part), order)
            for _, codes, real in texts.blocks():
                seen.append(np.unique(codes[real]))
                if sum(map(len, seen)) > 2_000_000:
                    seen = [np.unique(np.concatenate(seen))]
            size += len(texts.row)
            yield row(None, _packed(part))
            if size >= chunk_bytes:
                yield row(np.unique(np.concatenate(seen)), None)
                seen = []
        if seen:
            yield row(np.unique(np.concatenate(seen)), None)

    total = rows.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = min(MOST_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // chunk_bytes)))
    with small_batches(spark):
        stored = stage_bucketed(rows.mapInArrow(packs, "chunk bigint, codes array<bigint>, pack binary"), "packs", "chunk", buckets)
    wanted = stored.select("chunk", F.posexplode("codes").alias("pos", "g"))
    found = wanted.join(model.log_probabilities(wanted), "g").select(F.col("chunk").alias("of"), "pos", "lp")

    def settle(parts: pa.Table, found: pa.Table) -> pa.Table:
        codes = pc.list_flatten(parts["codes"].combine_chunks()).to_numpy()
        logs, find, out = np.zeros(len(codes)), _positions(codes), []
        logs[found["pos"].to_numpy()] = found["lp"].to_numpy()
        for pack in parts["pack"]:
            if not pack.is_valid:
                continue
            table = pa.ipc.open_stream(pack.as_buffer()).read_all()
            texts = Padded(_last(table), order)
            nll = np.zeros(len(texts.starts))
            for a, block, real in texts.blocks():
                values = np.zeros(len(block))
                values[real] = logs[find(block[real])]
                first = int(np.searchsorted(texts.starts, a, side="right")) - 1
                end = int(np.searchsorted(texts.starts, a + len(block)))
                nll[first:end] -= np.add.reduceat(values, np.maximum(texts.starts[first:end] - a, 0))
            made = table.select(table.column_names[:-1])
            out.append(made.append_column("n", pa.array(np.diff(_bytes_of(_last(table))[1]))).append_column("nll", pa.array(nll)))
        return pa.concat_tables(out)

    both = stored.select("chunk", "codes", "pack").groupBy("chunk").cogroup(found.groupBy("of"))
    return both.applyInArrow(settle, kept_schema.add("n", "long").add("nll", "double"))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Distinct ids that a label of quality 1 vouches for and none of quality 0 denies."""
    return labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def _thresholds(scored: DataFrame, quantile: float) -> tuple[DataFrame, float | None]:
    """Per language, and over all, the quantile of log perplexity in steps of a thousandth."""
    cells = scored.where(F.col(OWN + "apart") & (F.col("n") > 0)).groupBy("lang", F.ceil(F.col("lpp") * 1000).alias("cell")).agg(F.count("*").alias("m"))
    cells = stage(cells, "perplexities")

    def least(part: DataFrame, *by: str) -> DataFrame:
        # a cell is a thousandth of log perplexity, so each window holds a few thousand rows
        every = Window.partitionBy(*by)
        reached = part.withColumn("upto", F.sum("m").over(every.orderBy("cell"))).withColumn("every", F.sum("m").over(every))
        return reached.where(F.col("upto") >= quantile * F.col("every")).groupBy(*by).agg((F.min("cell") / 1000).alias("threshold"))

    row = least(cells.groupBy("cell").agg(F.sum("m").alias("m"))).first()
    return least(cells, "lang"), row[0] if row else None


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """The columns of ``docs`` but its text, with perplexity, threshold and ``kept``.

    ``docs`` needs doc_id, text and lang.  Columns named n, lpp, perplexity, threshold, trusted or
    kept are replaced.
    """
    own = {"text", "n", "nll", "lpp", "perplexity", "threshold", "trusted", "kept"}
    others = [c for c in docs.columns if c.lower() not in own]
    apart = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0
    trusted = stage(trusted_ids(labels).select(F.col("doc_id").alias(OWN + "id"), apart.alias(OWN + "apart")), "trusted")
    counted = trusted.where(~F.col(OWN + "apart"))
    right = F.broadcast(counted) if trusted.count() <= BROADCAST_IDS else counted
    texts = docs.join(right, docs["doc_id"] == trusted[OWN + "id"], "left_semi").where("text is not null").select("text")
    model = Model(count_ngrams(texts, order), order)
    scored = score(docs.select(*others, "text"), model)
    flagged = scored.join(trusted, scored["doc_id"] == trusted[OWN + "id"], "left").withColumn("trusted", F.col(OWN + "id").isNotNull()).drop(OWN + "id")
    flagged = stage(flagged.withColumn("lpp", F.when(F.col("n") > 0, F.col("nll") / F.col("n"))).drop("nll"), "scores")
    by_lang, overall = _thresholds(flagged, quantile)
    limits = stage(by_lang, "thresholds").select(F.col("lang").alias(OWN + "lang"), F.col("threshold").alias(OWN + "t"))
    limit = F.coalesce(F.col(OWN + "t"), F.lit(overall).cast("double"))
    joined = flagged.join(limits, flagged["lang"].eqNullSafe(limits[OWN + "lang"]), "left")
    kept: Column = (F.col("n") > 0) & F.coalesce(F.col("lpp") <= limit, F.lit(True))
    return joined.select(*others, "n", "trusted", F.exp("lpp").alias("perplexity"), F.exp(limit).alias("threshold"), kept.alias("kept"))
