"""The chunk function of SQL against the column expressions, on random texts and a long section."""

import random
import time

from scriptorium.operators import chunk_table as C
from scriptorium.operators import segments as S

PIECES = ["# h", "## h2", "#### deep", "```", "  ```py", "a | b | c", "|---|---|", "-|", "| x | y |", "", "  ", "para one", "longer paragraph of text " * 3, "\t", "#no"]


def _random(seed):
    made = random.Random(seed)
    return "\n".join(made.choice(PIECES) for _ in range(made.randrange(60)))


def test_equals_the_column_expressions(spark):
    rows = [(k, _random(k)) for k in range(300)] + [(300, None), (301, ""), (302, "x" * 500), (303, "\n\n"), (304, "```\n" + "code\n" * 80)]
    docs = spark.createDataFrame(rows, "id bigint, text string")
    for size, overlap in ((120, 20), (40, 0), (1000, 100)):
        want = sorted(tuple(r) for r in S.chunk_markdown(docs, "id", "text", size, overlap).collect())
        assert sorted(tuple(r) for r in C.chunk_rows(docs, "id", "text", size, overlap).collect()) == want


def test_long_section_and_control_characters(spark):
    text = "\n\n".join(f"block {k} \u0001 of a section" for k in range(100_000))
    docs = spark.createDataFrame([("a", text), ("a", "one"), (None, "two")], "id string, text string")
    before = time.time()
    found = C.chunk_rows(docs, "id", "text", overlap=0)
    got = found.collect()
    assert time.time() - before < 20 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert sum(r.chunk.count("\u0001") for r in got) == 100_000 and {(r.id, r.chunk) for r in got if r.chunk in ("one", "two")} == {("a", "one"), (None, "two")}
