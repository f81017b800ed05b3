"""Language identification as the mixture of languages in a document.

Training counts letter trigrams per language, hashed into a fixed number of cells, over every
row that may be learned from; the model (cells x languages) is bounded by its parameters and
not by the data.  A word's likelihood in a language is the product over its trigrams.  For
each document, expectation-maximisation estimates the proportion of each language among its
words.  Nested sets of the leading languages are refitted, and the set of greatest likelihood
less half the logarithm of the word count per extra language is selected; the prediction is
its largest member and the score that member's proportion.

All languages of the training rows are learned, and all of them may be selected together; more than ``MAX_LANGUAGES`` are refused.

Defined results: null texts and texts without a letter give ``und`` with score 0; ties go to
the language first in order; repeated rows get equal results; without training rows all are ``und``.
Scoring is per row with a broadcast model of fixed size: no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from .common import OWN, annotate

CELLS = 1 << 16
PIECE = 1 << 20
#: All languages are learned; a table of more (a quarter of a megabyte each) is refused, as the column is hardly one of languages.
MAX_LANGUAGES = 1_000
#: Sizes of the language set that are always tried, and sizes without a gain after which no more are.
LEAST_SIZES, PATIENCE = 4, 2
#: Words of a run of texts beyond which equal words of a text are held once, with their number.
HELD_WORDS = 1 << 19


@lru_cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(i).isalpha() for i in range(0x110000)])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _cells(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells at letters, which of these begin a word, and their positions.

    ``points`` are lower-case code points with a non-letter at either end.
    """
    mask = _letters()[points]
    clean = np.where(mask, points, 32).astype(np.uint64)
    at = np.flatnonzero(mask)
    with np.errstate(over="ignore"):
        h = clean[at - 1] * np.uint64(0x9E3779B97F4A7C15) + clean[at] * np.uint64(0xC2B2AE3D27D4EB4F) + clean[at + 1] * np.uint64(0x165667B19E3779F9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(48)).astype(np.int64) % CELLS, ~mask[at - 1], at


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces that end between words where possible."""
    start = 0
    while len(text) - start > PIECE:
        end = text.find(" ", start + PIECE)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:]


def _groups(values: list[str | None]) -> Iterator[tuple[int, int, str]]:
    """(first, past the last, joined lower-case text with a mark after each) for runs of texts."""
    first, size = 0, 0
    for i, v in enumerate(values):
        size += len(v or "")
        if size > PIECE or i == len(values) - 1:
            yield first, i + 1, "\n" + "".join((x or "").lower().replace("\0", " ") + "\0\n" for x in values[first : i + 1])
            first, size = i + 1, 0


def train(rows: DataFrame, text: str, lang: str, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log likelihood of each cell in each, from all given rows; ``ValueError`` if there are more than ``max_languages``.

    Each task adds up its own cells first, so what is shuffled is bounded by tasks x cells.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, total in sums.items():
                cells = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells, pa.int32()), pa.array(total[cells], pa.int64())], ["lang", "cell", "n"])
            sums.clear()

        for batch in batches:
            langs, values = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in sorted(set(langs)):
                mine = [v for v, k in zip(values, langs, strict=True) if k == name]
                total = sums.setdefault(name, np.zeros(CELLS, np.int64))
                for _, _, joined in _groups(mine):
                    for piece in _pieces(joined):
                        total += np.bincount(_cells(_points(f" {piece} "))[0], minlength=CELLS)
            if len(sums) > 64:
                yield from flush()
        yield from flush()

    known = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    names = sorted(r[0] for r in known.select("lang").distinct().limit(max_languages + 1).collect())
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages; is {lang} their column?")
    smooth = 0.5
    table = np.full((CELLS, len(names)), -np.log(CELLS), np.float32)
    if names:
        code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("lang")).cast("int") - 1
        counted = known.mapInArrow(count, "lang string, cell int, n bigint")
        # at most cells x languages rows of three numbers
        got = counted.groupBy(code.alias("k"), "cell").agg(F.sum("n").alias("n")).toPandas()
        for k, mine in got.groupby("k"):
            own = np.zeros(CELLS)
            own[mine["cell"].to_numpy()] = mine["n"].to_numpy(dtype=float)
            table[:, k] = np.log((own + smooth) / (own.sum() + smooth * CELLS))
    return names, table


class _Words:
    """The words of a run of texts: their log likelihoods, texts and numbers; equal words of a text are merged when they are many."""

    def __init__(self, held_words: int):
        self.parts: list[tuple[np.ndarray, ...]] = []  # text, hash of the word, likelihoods, number
        self.size, self.most = 0, held_words

    def add(self, owner: np.ndarray, mark: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((owner, mark, scores, np.ones(len(owner), np.float32)))
        self.size += len(owner)
        if self.size > self.most:
            owner, mark, scores, number = self.whole()
            order = np.lexsort((mark, owner))
            new = np.flatnonzero(np.concatenate([[True], (owner[order][1:] != owner[order][:-1]) | (mark[order][1:] != mark[order][:-1])]))
            self.parts = [(owner[order][new], mark[order][new], scores[order][new], np.add.reduceat(number[order], new))]
            self.size = len(new)
            self.most = max(self.most, 2 * self.size)

    def whole(self) -> tuple[np.ndarray, ...]:
        return tuple(np.concatenate(x) for x in zip(*self.parts, strict=True))


def _em(like: np.ndarray, starts: np.ndarray, owner: np.ndarray, number: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after some rounds, and each document's log likelihood (up to a constant)."""
    for _ in range(rounds):
        joint = like * share[owner]
        joint *= (number / np.maximum(joint.sum(1), 1e-30))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / sizes[:, None]
    mixed = np.log(np.maximum((like * share[owner]).sum(1), 1e-30)) * number
    return share, np.add.reduceat(mixed.astype(np.float64), starts)


def mixtures(values: list[str | None], table: np.ndarray, held_words: int = HELD_WORDS) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """For each text the selected languages (by falling share) and their shares; None without letters."""
    out: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(values)
    n_langs = table.shape[1]
    if not n_langs:
        return out
    for first, last, joined in _groups(values):
        words, done = _Words(held_words), 0
        for piece in _pieces(joined):
            points = _points(f" {piece} ")
            cells, begins, at = _cells(points)
            marks = np.flatnonzero(points == 0)
            if len(cells):
                starts = np.flatnonzero(begins)
                place = np.arange(len(cells)) - np.repeat(starts, np.diff(np.append(starts, len(cells))))
                with np.errstate(over="ignore"):
                    mark = np.add.reduceat((cells + 1).astype(np.uint64) * ((place + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)), starts)
                words.add(done + np.searchsorted(marks, at[starts]), mark, np.add.reduceat(table[cells], starts, axis=0))
            done += len(marks)
        if not words.parts:
            continue
        owner, _, scores, number = words.whole()
        order = np.argsort(owner, kind="stable")
        owner, scores, number = owner[order], scores[order], number[order]
        like = np.exp(scores - scores.max(1, keepdims=True))
        ids, starts, rows = np.unique(owner, return_index=True, return_counts=True)
        owner, sizes = np.repeat(np.arange(len(ids)), rows), np.add.reduceat(number.astype(np.float64), starts)
        share, _ = _em(like, starts, owner, number, sizes, np.full((len(ids), n_langs), 1 / n_langs, np.float32), 8)
        order = np.argsort(-share, axis=1, kind="stable")
        best_value = best_share = None
        best_size, idle = np.ones(len(ids), int), 0
        for k in range(1, n_langs + 1):
            if idle >= PATIENCE and k > LEAST_SIZES:
                break
            allowed = np.zeros_like(share)
            np.put_along_axis(allowed, order[:, :k], 1, axis=1)
            begin = share * allowed + 1e-6 * allowed
            fitted, value = _em(like, starts, owner, number, sizes, (begin / begin.sum(1, keepdims=True)).astype(np.float32), 0 if k == 1 else 4)
            value = value - (k - 1) * (0.5 * np.log(sizes) + np.log(n_langs))
            if best_value is None:
                best_value, best_share = value, fitted
            else:
                better = value > best_value
                best_value, best_share = np.where(better, value, best_value), np.where(better[:, None], fitted, best_share)
                best_size[better] = k
                idle = 0 if better.any() else idle + 1
        for i, doc in enumerate(ids):
            langs = order[i, : best_size[i]]
            langs = langs[np.argsort(-best_share[i, langs], kind="stable")]
            out[first + doc] = (langs, best_share[i, langs])
    return out


def mixture_column(text: Column, names: list[str], table: np.ndarray, session) -> Column:
    shared = session.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = mixtures(batch.to_pylist(), shared.value)
            yield pa.StructArray.from_arrays(
                [
                    pa.array([names[m[0][0]] if m else "und" for m in found], pa.string()),
                    pa.array([min(1.0, float(m[1][0])) if m else 0.0 for m in found], pa.float64()),
                    pa.array([[names[k] for k in m[0]] if m else [] for m in found], pa.list_(pa.string())),
                    pa.array([[float(x) for x in m[1]] if m else [] for m in found], pa.list_(pa.float64())),
                ],
                ["lang_pred", "score", "languages", "shares"],
            )

    return arrow_udf(run, "lang_pred string, score double, languages array<string>, shares array<double>", ArrowUDFType.SCALAR_ITER)(text)


def identify(docs: DataFrame, names: list[str], table: np.ndarray, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score``, ``languages`` and ``shares``; such columns are replaced."""
    return annotate(docs, mixture_column(F.col(text), names, table, docs.sparkSession), ["lang_pred", "score", "languages", "shares"])


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept out of training; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict_languages(docs: DataFrame) -> DataFrame:
    """One row per document: fold, predicted language and score, learned from the other folds."""
    names, table = train(docs.where(~held_out(F.col("doc_id"))), "text", "lang")
    # the predictor sees only the text; id and fold ride along
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").alias(OWN + "t"))
    return identify(rows, names, table, OWN + "t").select("doc_id", "held_out", "lang_pred", "score", "languages", "shares")
