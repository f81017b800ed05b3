"""Quality rules: a linear-chain conditional random field labels the lines of a document.

Every line that has a word is described by a fixed set of features of its words, marks, case
and repeats.  The field scores each line as content or boilerplate, and each pair of
neighbours; Viterbi decoding finds the best labelling.  A document is kept if it passes the
base rules and lines marked content hold at least ``content_share`` of its word characters.

The weights are fitted here by gradient ascent on the conditional likelihood.  Line labels come
from document labels (quality 1: content, 0: boilerplate).  The fit uses at most
``max_fit_docs`` documents of each quality, those with the lowest hash of their text; that
bound is the only sample.  Scoring is per row over whole texts: no shuffle, and a task holds
one Arrow batch.  Without labels of both kinds the prior weights are used.

Defined results: a null or empty text has no words, fails the base rules and is not kept.
Repeated rows get equal results.  Ties in decoding go to content.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from ..staging import stage
from .common import annotate, struct_of

MAX_FIT_DOCS, MAX_FIT_LINES = 1500, 60
CONTENT_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
_LOUD, _DIGITS, _UPPER, _ENDS = b"!?", b"0123456789", bytes(range(65, 91)), (b".", b"!", b"?", b":", b";", b'"')
_WHITE = " \t\n\v\f\r"
FEATURES = ("bias", "log_words", "symbols", "loud", "digits", "upper", "repeats", "neighbours", "ends", "seen", "short", "word_length")
#: Used where there is nothing to fit; positive favours content.
PRIOR = np.array([1.0, 0.2, -8.0, -6.0, -4.0, -6.0, -4.0, -6.0, 0.3, -0.3, -0.2, 0.0])


def line_features(words: list[bytes], line: bytes, seen: bool) -> tuple:
    n, size = len(words), max(len(line), 1)
    return (
        1.0,
        min(n, 400) ** 0.5 / 10,
        min(1.0, 4 * (len(line) - len(line.translate(None, SYMBOLS))) / size),
        min(1.0, 4 * (len(line) - len(line.translate(None, _LOUD))) / size),
        (len(line) - len(line.translate(None, _DIGITS))) / size,
        (len(line) - len(line.translate(None, _UPPER))) / size,
        1 - len(set(words)) / n if n >= 8 else 0.0,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        float(line.endswith(_ENDS)),
        float(seen),
        1.0 / n,
        min(2.0, size / n / 10),
    )


def analyse(text: str) -> tuple[tuple, list[tuple], list[int]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), line features, line word characters."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - sum(map(text.count, _WHITE)) if words else 0
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    rows, sizes, again = [], [], 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        known = line in seen
        again += known
        seen.add(line)
        rows.append(line_features(own, b" ".join(own), known))
        sizes.append(sum(map(len, own)))
    return (len(words), word_chars, n_symbols, again, repeat_words(words)), rows, sizes


def repeat_words(words: list[bytes]) -> int:
    """Words inside windows of three words that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    a, b, c = ids[:-2], ids[1:-1], ids[2:]
    if len(known) < 1 << 21:  # three numbers of words in one
        whole = a << 42 | b << 21 | c
        order = np.argsort(whole, kind="stable")
        same = whole[order][1:] == whole[order][:-1]
    else:
        order = np.lexsort((c, b, a))
        same = np.logical_and.reduce([x[order][1:] == x[order][:-1] for x in (a, b, c)])
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


class Field:
    """Weights of the field: features for content against boilerplate, and four transitions."""

    def __init__(self, emission: np.ndarray = PRIOR, transition: np.ndarray | None = None):
        self.emission = np.asarray(emission, float)
        self.transition = np.zeros((2, 2)) if transition is None else np.asarray(transition, float)

    def decode(self, rows: list[tuple]) -> list[bool]:
        """Viterbi: for each line, whether the best labelling calls it content."""
        if not rows:
            return []
        scores = (np.array(rows) @ self.emission).tolist()
        (bb, bc), (cb, cc) = self.transition.tolist()
        b, c, back = 0.0, scores[0], []
        for s in scores[1:]:
            from_c_b, from_c_c = c + cb > b + bb, c + cc >= b + bc
            back.append((from_c_b, from_c_c))
            b, c = (c + cb if from_c_b else b + bb), (c + cc if from_c_c else b + bc) + s
        state, out = c >= b, []
        out.append(state)
        for to_b, to_c in reversed(back):
            state = to_c if state else to_b
            out.append(state)
        return out[::-1]

    def gradient(self, rows: np.ndarray, label: int) -> tuple[np.ndarray, np.ndarray]:
        """Of the log likelihood that all lines have one label (forward and backward sums)."""
        score, n = rows @ self.emission, len(rows)
        unary = np.stack([np.zeros(n), score], 1)
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        alpha[0] = unary[0]
        for i in range(1, n):
            alpha[i] = unary[i] + np.logaddexp(alpha[i - 1, 0] + self.transition[0], alpha[i - 1, 1] + self.transition[1])
        for i in range(n - 2, -1, -1):
            ahead = unary[i + 1] + beta[i + 1]
            beta[i] = np.logaddexp(self.transition[:, 0] + ahead[0], self.transition[:, 1] + ahead[1])
        total = np.logaddexp(alpha[-1, 0], alpha[-1, 1])
        p_content = np.exp(alpha[:, 1] + beta[:, 1] - total)
        g_emission = ((label == 1) - p_content) @ rows
        g_transition = np.zeros((2, 2))
        if n > 1:
            pair = alpha[:-1, :, None] + self.transition + (unary[1:] + beta[1:])[:, None, :] - total
            g_transition = -np.exp(pair).sum(0)
            g_transition[label, label] += n - 1
        return g_emission, g_transition


def fit(data: list[tuple[np.ndarray, int]], rounds: int = 12) -> Field:
    """A field fitted to (features of a document's lines, quality) pairs."""
    data = [(rows, label) for rows, label in data if len(rows)]
    labels = {label for _, label in data}
    field = Field(PRIOR.copy())
    if labels != {0, 1}:
        return field
    weight = {k: 0.5 * len(data) / sum(label == k for _, label in data) for k in labels}
    square_e, square_t = np.full(len(FEATURES), 1e-6), np.full((2, 2), 1e-6)
    order = np.random.default_rng(0)
    for _ in range(rounds):
        for start in (shuffled := order.permutation(len(data))).reshape(-1)[::32]:
            at = int(np.flatnonzero(shuffled == start)[0])
            g_e, g_t = -0.02 * (field.emission - PRIOR), -0.02 * field.transition
            for k in shuffled[at : at + 32]:
                rows, label = data[k]
                e, t = field.gradient(rows, label)
                g_e, g_t = g_e + weight[label] * e / len(rows), g_t + weight[label] * t / len(rows)
            square_e, square_t = square_e + g_e**2, square_t + g_t**2
            field.emission += 0.5 * g_e / np.sqrt(square_e)
            field.transition += 0.5 * g_t / np.sqrt(square_t)
    return field


def fit_lines(text: str, max_lines: int = MAX_FIT_LINES) -> list[float]:
    """Features of at most ``max_lines`` evenly spaced lines of the whole text, one after another."""
    rows = analyse(text)[1]
    step = -(-len(rows) // max_lines) or 1
    return [x for row in rows[::step] for x in row]


def fit_from_labels(docs: DataFrame, labels: DataFrame, max_fit_docs: int = MAX_FIT_DOCS) -> Field:
    """A field fitted to at most ``max_fit_docs`` labelled documents of each quality.

    Executors describe the lines; the driver gets only features of the bounded sample.
    """

    def describe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fit_lines(t) for t in batch.to_pylist()], pa.list_(pa.float64()))

    described = arrow_udf(describe, "array<double>", ArrowUDFType.SCALAR_ITER)
    marked = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    # only documents that are there take part in the choice
    marked = stage(marked.join(docs.where(F.col("text").isNotNull()).select("doc_id"), "doc_id", "left_semi"), "labelled")
    data = []
    for quality in (0, 1):
        # a bounded list of ids first, so that the texts are only scanned and filtered
        ids = [r[0] for r in marked.where(F.col("quality") == quality).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit_docs).collect()]
        chosen = docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull())
        lines = chosen.select(F.xxhash64("text").alias("h"), described("text").alias("x")).orderBy("h", "x").limit(max_fit_docs)
        data += [(np.array(r.x).reshape(-1, len(FEATURES)), quality) for r in lines.collect()]
    return fit(data)


RESULT = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
    ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("n_content_lines", pa.int64()),
])
_RESULT_SQL = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, n_content_lines bigint"


def judge(text: str, field: Field, content_share: float = CONTENT_SHARE) -> tuple:
    base, rows, sizes = analyse(text)
    failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
    marks = field.decode(rows)
    total = sum(sizes)
    share = sum(s for s, m in zip(sizes, marks, strict=True) if m) / total if total else 0.0
    return (*base, failed, not failed and share >= content_share, share, sum(marks))


def quality_column(text: Column, field: Field, content_share: float = CONTENT_SHARE) -> Column:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield struct_of([judge(t or "", field, content_share) for t in batch.to_pylist()], RESULT)

    return arrow_udf(run, _RESULT_SQL, ArrowUDFType.SCALAR_ITER)(text)


def line_quality(docs: DataFrame, field: Field, text: str = "text", content_share: float = CONTENT_SHARE) -> DataFrame:
    """``docs`` with the base counts, the verdict and the share of content; such columns are replaced."""
    return annotate(docs, quality_column(F.col(text), field, content_share), [f.name for f in RESULT])
