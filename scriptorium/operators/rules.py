"""Declarative rules over short texts: keyword scores, levels, gates and the best per text.

A rule pack is a list of ``Rule``.  Evaluating it is a narrow transformation: every text is searched once for all words of the pack by
one automaton, scores all rules in place and keeps its best ones, without a cross join and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType, arrow_udf

from ..functions.text import keyword_hits, squash

LEVELS = ("none", "low", "medium", "high")


@dataclass(frozen=True)
class Rule:
    """One risk: its words, and what gates and grades it."""

    risk_type: str
    keywords: tuple[str, ...]
    strong: tuple[str, ...] = ()
    related: tuple[str, ...] = ()
    medium_at: int = 2
    low_at: int = 1
    required_any: tuple[str, ...] = ()
    combinations: tuple[tuple[str, ...], ...] = ()
    blocked: tuple[str, ...] = ()
    blocked_max: int = 0
    require_strong: bool = False
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def all_of_any(text: Column, combinations: tuple[tuple[str, ...], ...]) -> Column:
    """True if there are none, or if all words of one of them are in the text."""
    if not combinations:
        return F.lit(True)
    out = F.lit(False)
    for words in combinations:
        if words:
            met = F.lit(True)
            for w in words:
                met = met & F.contains(text, F.lit(w))
            out = out | met
    return out


def group_hits(text: Column, groups: dict[str, tuple[str, ...]]) -> Column:
    """Map from group name to the words of it that the text has."""
    if not groups:
        return F.create_map().cast("map<string,array<string>>")
    return F.create_map(*[x for name, words in groups.items() for x in (F.lit(name), keyword_hits(text, _strings(words)))])


class WordPack:
    """The distinct words of a pack, and one automaton that finds all of them in one pass over a text.

    Words that overlap or lie in one another are all found, and the time does not depend on their number.
    ``found`` gives a row of booleans per text; tests on it are operations on whole columns.
    """

    def __init__(self, words: Iterable[str]):
        import ahocorasick

        self.place = {w: i for i, w in enumerate(dict.fromkeys(words))}
        self.automaton = ahocorasick.Automaton()
        for w, i in self.place.items():
            if w:
                self.automaton.add_word(w, i)
        self.automaton.make_automaton()

    def found(self, texts: list[str | None]) -> np.ndarray:
        """Whether each text (null: empty) holds each word; the empty word is in all."""
        held = np.zeros((len(texts), len(self.place)), bool)
        if any(self.place):
            search = self.automaton.iter
            rows, places = [], []
            for row, text in enumerate(texts):
                if text:
                    here = {i for _, i in search(text)}
                    places += here
                    rows += [row] * len(here)
            held[rows, places] = True
        if "" in self.place:
            held[:, self.place[""]] = True
        return held

    def of(self, words: Iterable[str]) -> list[int]:
        return [self.place[w] for w in dict.fromkeys(words)]


def words_of_rules(rules: list[Rule]) -> list[str]:
    """All words that any list of the rules has."""
    return [w for r in rules for part in (r.keywords, r.strong, r.required_any, r.blocked, *r.combinations, *r.groups.values()) for w in part]


CHECKS = ("strong", "groups", "required_any", "combinations", "not_blocked")
CHOSEN = pa.struct([(c, pa.int32()) for c in ("rule", "level", "confidence", "strong_count", "keyword_count")] + [("checks", pa.struct([(c, pa.bool_()) for c in CHECKS]))])
CHOSEN_DDL = f"array<struct<rule:int,level:int,confidence:int,strong_count:int,keyword_count:int,checks:struct<{','.join(c + ':boolean' for c in CHECKS)}>>>"


def evaluate(pack: WordPack, held: np.ndarray, kinds: list[str], rule: Rule) -> tuple[np.ndarray, ...]:
    """Level (0: no risk), confidence, strong hits, keyword hits and the gates of one rule, for each row of ``held``."""
    n = len(held)

    def count(words: Iterable[str]) -> np.ndarray:
        return held[:, pack.of(words)].sum(axis=1, dtype=np.int32)

    def each(parts: Iterable[np.ndarray], start: bool) -> np.ndarray:
        return reduce((lambda x, y: x & y) if start else (lambda x, y: x | y), parts, np.full(n, start))

    n_words, n_strong = count(rule.keywords), count(rule.strong)
    by_kind = {k: any(name in k for name in rule.related) for k in {*kinds}}
    related = np.array([by_kind[k] for k in kinds], bool)
    groups = each((count(words) > 0 for words in rule.groups.values()), True)
    required = count(rule.required_any) > 0 if rule.required_any else np.ones(n, bool)
    combinations = each((count(words) == len({*words}) for words in rule.combinations if words), False) if rule.combinations else np.ones(n, bool)
    blocked = (count(rule.blocked) > 0) & (n_words <= rule.blocked_max) & (n_strong == 0)
    strong_ok = n_strong > 0 if rule.require_strong else np.ones(n, bool)
    confidence = 6 * n_strong + 2 * n_words + related + groups
    passed = strong_ok & groups & required & combinations & ~blocked & (n_words + n_strong > 0)
    level = np.select(
        [~passed, n_strong > 0, (n_words >= rule.medium_at) | (confidence >= 6), (n_words >= rule.low_at) | (related & (n_words >= 1))], [0, 3, 2, 1], 0
    )
    return level, confidence, n_strong, n_words, np.stack([strong_ok, groups, required, combinations, ~blocked], axis=1)


def choose(made: list[tuple[np.ndarray, ...]], key_only: bool) -> pa.Array:
    """The best rules of each row: up to two of medium or high, else one low."""
    level, confidence, strong, words = (np.stack([m[i] for m in made], axis=1).astype(np.int32) for i in range(4))
    order = np.lexsort((-words, -strong, -confidence, -level), axis=-1)  # stable: the order of the rules last
    best = np.take_along_axis(level, order, axis=1)
    keep = np.zeros(level.shape, bool)
    keep[:, :2] = best[:, :2] >= 2
    keep[:, 0] |= best[:, 0] > 0
    if key_only:
        firm = (strong > 0) | (words >= 3) | (confidence >= 8)
        keep &= (best == 3) | ((best == 2) & np.take_along_axis(firm, order, axis=1))
    row, place = np.nonzero(keep)
    rule = order[row, place]
    checks = np.stack([m[4] for m in made], axis=1)[row, rule]
    gates = pa.StructArray.from_arrays([pa.array(checks[:, i]) for i in range(len(CHECKS))], names=list(CHECKS))
    fields = [rule.astype(np.int32), *(x[row, rule] for x in (level, confidence, strong, words))]
    chosen = pa.StructArray.from_arrays([*(pa.array(f, pa.int32()) for f in fields), gates], fields=list(CHOSEN))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(keep.sum(axis=1)))), pa.int32()), chosen)


def chosen_rules(text: Column, clause_type: Column, rules: list[Rule], key_only: bool = False) -> Column:
    """Array of the best rules of a squashed text, with what each has of it."""
    held: list[WordPack] = []

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        if not held:
            held.append(WordPack(words_of_rules(rules)))
        for texts, kinds in batches:
            found, names = held[0].found(texts.to_pylist()), [k or "" for k in kinds.to_pylist()]
            yield choose([evaluate(held[0], found, names, rule) for rule in rules], key_only)

    return arrow_udf(run, CHOSEN_DDL, ArrowUDFType.SCALAR_ITER)(text, clause_type)


def find_words(text: Column, words: list[str]) -> Column:
    """The words of a pack that a squashed text holds, in the order of the pack; null and empty texts hold none."""
    listed, held = list(dict.fromkeys(words)), []

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if not held:
            held.append(WordPack(listed))
        names = pa.array(listed, pa.string())
        for batch in batches:
            found = held[0].found(batch.to_pylist())
            found[batch.is_null().to_numpy(zero_copy_only=False)] = False
            ends = pa.array(np.concatenate(([0], np.cumsum(found.sum(axis=1)))), pa.int32())
            yield pa.ListArray.from_arrays(ends, names.take(pa.array(np.nonzero(found)[1])))

    return arrow_udf(run, "array<string>", ArrowUDFType.SCALAR_ITER)(text) if listed else F.array().cast("array<string>")


def identify_risks(clauses: DataFrame, rules: list[Rule], text: str = "text", clause_type: str = "clause_type", key_only: bool = False) -> DataFrame:
    """One row per clause and risk: up to two of medium or high, else one low, else one without risk.

    Order: level, confidence, strong hits, keyword hits, then the order of the rules.  ``key_only``
    keeps only key risks, as for attachments.  A text is searched once for all words of the pack; the words shown as triggers
    are looked up for the chosen rules only.
    """
    chosen = chosen_rules(F.col("__t"), F.col(clause_type), rules, key_only) if rules else F.array().cast(CHOSEN_DDL)
    rows = clauses.withColumn("__t", squash(F.col(text))).withColumn("__c", chosen)
    out = rows.select(*clauses.columns, "__t", F.posexplode_outer("__c").alias("risk_no", "r"))
    level, which, none = F.coalesce(F.col("r.level"), F.lit(0)), F.col("r.rule") + 1, F.col("r.rule").isNull()
    words = F.array(*[_strings(tuple(dict.fromkeys((*r.strong, *r.keywords)))) for r in rules])
    shown = F.slice(F.filter(F.element_at(words, which), lambda w: F.contains(F.col("__t"), w)), 1, 8) if rules else F.lit(None)
    return out.select(
        *clauses.columns,
        (F.coalesce("risk_no", F.lit(0)) + 1).alias("risk_no"),
        F.when(none, "no risk").otherwise(F.element_at(_strings(tuple(r.risk_type for r in rules) or ("",)), which)).alias("risk_type"),
        F.element_at(_strings(LEVELS), level + 1).alias("risk_level"),
        F.coalesce("r.confidence", F.lit(0)).alias("confidence"),
        F.coalesce("r.strong_count", F.lit(0)).alias("strong_count"),
        F.coalesce("r.keyword_count", F.lit(0)).alias("keyword_count"),
        F.when(none, F.array().cast("array<string>")).otherwise(shown).alias("triggers"),
        F.col("r.checks").alias("checks"),
        (level >= 2).alias("needs_attention"),
        F.when(none, False).otherwise(is_key_risk(F.col("r"))).alias("is_key"),
    )


def is_key_risk(r: Column) -> Column:
    """High, or medium with a strong hit, or with three keywords, or with confidence of eight."""
    return (r["level"] == 3) | ((r["level"] == 2) & ((r["strong_count"] > 0) | (r["keyword_count"] >= 3) | (r["confidence"] >= 8)))


def classify(text: Column, section_title: Column, section: Column, titles: dict[str, str], numbers: dict[str, str], keywords: dict[str, tuple[str, ...]], default: str) -> Column:
    """The type by title, else by number, else by most keywords (the first type wins a tie), else the default."""

    def look(table: dict[str, str], value: Column) -> Column:
        return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value) if table else F.lit(None).cast("string")

    squashed = squash(text)
    scored = F.array(*[F.struct(F.size(keyword_hits(squashed, _strings(words))).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("t")) for i, (name, words) in enumerate(keywords.items())])
    best = F.array_max(scored)
    return F.coalesce(look(titles, section_title), look(numbers, section), F.when(best["n"] > 0, best["t"]), F.lit(default))


def parse_metrics(clauses: DataFrame, key: str, text: str, title: Column, long: int = 1200) -> DataFrame:
    """(key, n_clauses, n_titles, mean_chars, under_segmented): how well documents were cut; at most one clause of more than ``long`` characters is too few."""
    n = F.length(text)
    return clauses.groupBy(key).agg(
        F.count("*").alias("n_clauses"), F.countDistinct(title).alias("n_titles"), F.floor(F.avg(n)).alias("mean_chars"), ((F.count("*") <= 1) & (F.sum(n) > long)).alias("under_segmented")
    )


def report_rollup(risks: DataFrame, key: str, few: int = 3) -> DataFrame:
    """(key, critical, warning, notice, status): risks by level, and ``critical``, ``safe``, ``attention`` (up to ``few``) or ``warning`` in all."""
    level = F.col("risk_level")
    counted = risks.groupBy(key).agg(*[F.count_if(level == a).alias(b) for a, b in (("high", "critical"), ("medium", "warning"), ("low", "notice"))])
    rows = F.col("warning") + F.col("notice")
    return counted.withColumn("status", F.when(F.col("critical") > 0, "critical").when(rows == 0, "safe").when(rows <= few, "attention").otherwise("warning"))


def focus_list(risks: DataFrame, key: str, clause_id: Column) -> DataFrame:
    """(key, focus): the ids of the clauses with a high risk, each once, shorter ids first."""
    ids = risks.where("risk_level = 'high'").groupBy(key).agg(F.collect_set(clause_id).alias("ids"))
    ordered = F.array_sort(F.transform("ids", lambda i: F.struct(F.length(i).alias("n"), i.alias("i"))))
    return ids.select(key, F.array_join(F.transform(ordered, lambda x: x["i"]), ",").alias("focus"))


def risk_summary(risks: DataFrame, key: str) -> DataFrame:
    """Per document: risks, those that need attention, high ones, key ones, and the count per type."""
    is_risk = F.col("risk_level") != "none"
    kinds = risks.groupBy(key, "risk_type").agg(
        F.count("*").alias("total"), F.count_if("needs_attention").alias("attention"), F.count_if(F.col("risk_level") == "high").alias("high"), F.count_if("is_key").alias("key_risks"), F.count_if(is_risk).alias("n")
    )
    entry = F.when(F.col("n") > 0, F.struct("risk_type", "n"))
    made = kinds.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("total", "attention", "high", "key_risks")], F.array_sort(F.collect_list(entry)).alias("__e"))
    return made.withColumn("risk_type_counts", F.when(F.size("__e") > 0, F.map_from_entries("__e"))).drop("__e")


def risk_cube(risks: DataFrame, dimensions: list[str], sets: list[list[str]] | None = None) -> DataFrame:
    """Risks counted over every set of the dimensions (or the sets given) in one pass: the dimensions, ``totals``, n, confidence, high, documents.

    A dimension that a set leaves out is null there; ``totals`` has a bit for each one left out, the first dimension the highest, so a
    null of the data and a total are told apart.
    """
    rows = risks.select(*dimensions, "doc_id", "confidence", (F.col("risk_level") == "high").alias("__high"))
    grouped = rows.cube(*dimensions) if sets is None else rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dimensions])
    return grouped.agg(
        F.grouping_id().cast("long").alias("totals"), F.count("*").alias("n"), F.sum("confidence").alias("confidence"), F.count_if("__high").alias("high"), F.countDistinct("doc_id").alias("documents")
    )
