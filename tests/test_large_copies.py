"""What large copies made slow or large: the same results as plain Python, and plans and tasks that grow with the rows."""

import math
import random
import re

import pytest

from lodestar.operators import graph, macros, search, symbols
from lodestar.plans import scratch


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark):
    scratch.checkpoints(spark)


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of what is checkpointed, as they ran."""
    seen, kind = [], type(spark.range(1))
    plain = kind.checkpoint

    def checkpoint(self, *args, **more):
        out = plain(self, *args, **more)
        seen.append(self._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(kind, "checkpoint", checkpoint)
    return seen


def test_macros_are_not_sent_to_the_driver(spark, plans):
    rng = random.Random(3)
    of = {i: {rng.randrange(40) for _ in range(rng.randrange(3))} for i in range(40)}
    starts, want = range(0, 40, 3), {}
    for s in starts:
        front, steps = {s}, 0
        while front:
            steps += 1
            front = {b for a in front for b in of[a]} - {b for a, b in want if a == s}
            want |= {(s, b): steps for b in front}
    got = macros.closure(spark.createDataFrame([(f"m{a}", f"m{b}") for a in of for b in of[a]], "macro string, base string"), spark.createDataFrame([(f"m{s}",) for s in starts], "macro string"))
    assert {(r["macro"], r["base"]): r["steps"] for r in got.collect()} == {(f"m{a}", f"m{b}"): n for (a, b), n in want.items()} and got.count() == len(want)
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


@pytest.mark.parametrize("few", [0, 1000])
def test_parts_of_names_in_tasks_by_their_number(spark, monkeypatch, few):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    calls, known = [word(rng.randrange(1, 12)) for _ in range(120)] + ["", "(x)", "zz"], [word(rng.randrange(2, 12)) for _ in range(60)] + ["(y)"]
    want = {}
    for name in {*calls}:
        norm = name.partition("(")[0]
        tests = (lambda k: k == name, lambda k: k.partition("(")[0] == norm, lambda k: norm and (n := k.partition("(")[0]) and (n in norm or norm in n))  # noqa: B023
        want[name] = next(((k, step) for step, t in enumerate(tests, 1) for k in known if t(k)), (None, None))
    monkeypatch.setattr(symbols, "FEW", few)
    monkeypatch.setattr(symbols, "PIECES", 100)
    got = symbols.found_functions(spark.createDataFrame([(c,) for c in calls], "name string"), spark.createDataFrame(list(enumerate(known)), "place int, key string")).collect()
    assert {r["name"]: (r["key"], r["step"]) for r in got} == want and len(got) == len(want)
    long = spark.createDataFrame([("n", word(60))], "name string, norm string")
    made = symbols._parts(long, spark.createDataFrame([(word(k),) for k in range(1, 40)], "norm string"))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert max(map(int, re.findall(r"hashpartitioning\(.*?, (\d+)\), REPARTITION_BY_NUM", plan))) > 10  # 1,600 pieces
    assert "HashAggregate" not in plan.split("Broadcast")[0]  # pieces are not grouped


@pytest.mark.parametrize("words", [0, 1000])
def test_scores_of_blocks_of_documents(spark, monkeypatch, words):
    rng = random.Random(5)
    vocabulary = "a b c d e f g h xx yy".split()
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(n)))
    docs, queries = {i: text(30) for i in range(150)}, {f"q{i}": text(8) for i in range(20)} | {"none": "zzz"}
    docs[150], docs[151] = None, docs[3]
    split = {i: (t or "").split() for i, t in docs.items()}
    full = [w for w in split.values() if w]
    mean = sum(map(len, full)) / len(full)
    want = {}
    for q, t in queries.items():
        scores = {}
        for i, w in split.items():
            for x in {*t.split()} & {*w}:
                df, tf = sum(x in v for v in full), w.count(x)
                scores[i] = scores.get(i, 0) + math.log(1 + (len(full) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        want |= {(q, rank): i for rank, (_, i) in enumerate(sorted((-round(s, 6), i) for i, s in scores.items())[:3], 1)}
    monkeypatch.setattr(search, "BROADCAST_WORDS", words)
    monkeypatch.setattr(search, "CELLS", 200)
    found = search.bm25(spark.createDataFrame([*queries.items()], "q string, text string"), spark.createDataFrame([*docs.items()], "id int, text string"), 3)
    assert {(r["q"], r["rank"]): r["id"] for r in found.collect()} == want
    assert found.schema["id"].dataType.simpleString() == "int"
    none = search.bm25(spark.createDataFrame([("q", "zzz")], "q string, text string"), spark.createDataFrame([*docs.items()], "id int, text string"), 3)
    assert none.count() == 0
    if words:
        assert "MapInArrow" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "Join" not in plan  # no row for each word and query


def test_rings_are_found_with_a_checkpoint_a_step(spark, plans):
    ring, tail = [(i, (i + 1) % 12) for i in range(12)], [(20, 3), (7, 30), (30, 31), (31, 32), (32, 31)]
    got = graph.strong_components(spark.createDataFrame(ring + tail, "src int, dst int"))
    steps = len(plans)
    assert {r["node"]: r["component"] for r in got.collect()} == {i: 0 for i in range(12)} | {20: 20, 30: 30, 31: 31, 32: 31}
    assert steps < 52, steps  # 60 when what is found was stored anew at every step
