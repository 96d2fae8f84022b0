"""The filter interaction audit against a plain walk through every order."""

import random
import re
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from textsentry.llm import audit

COLUMNS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(rows):
    """(part, set of failed filters) of each (doc_id, text, source)."""
    least = {}
    for key, text, _ in rows:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    for key, text, source in rows:
        text = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": key is not None and least.get(text, key) < key,
        }
        yield source or "", {k for k, v in tests.items() if v}


def brute(rows, labels):
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    parts = defaultdict(list)
    for (key, *_), (part, failed) in zip(rows, failures(rows), strict=True):
        parts[part].append((failed, key in good, key in toxic))
    out = {}
    for part, docs in parts.items():
        shapley = defaultdict(int)
        for order in permutations("ABCDE"):
            left = docs
            for step, name in enumerate(order, 1):
                gone = [d for d in left if name in d[0]]
                left = [d for d in left if name not in d[0]]
                fails = sum(name in d[0] for d in docs)
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), fails - len(gone), sum(d[0] == {name} for d in docs),
                    sum(d[1] for d in gone), sum(d[2] for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audited(docs, labels):
    got = audit.audit_documents(docs, labels).collect()
    out = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in COLUMNS] for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_every_step_equals_a_plain_walk(documents, labels):
    rng = random.Random(5)
    texts = [None, "", " \t ", "SHOUT a b", "a # b", "é" * 60 + " AB"]
    texts += [" ".join(rng.choice([f"w{i}" for i in range(rng.choice([5, 400]))]) for _ in range(n)) for n in (199, 200, 201, 300) for _ in range(3)]
    texts += [t + " |" for t in texts[-4:]] + [t.upper() for t in texts[-4:]]
    rows = [(i // 2 if i % 9 == 0 else i, rng.choice(texts), "en", rng.choice(["a", "b", "c", None, ""])) for i in range(150)]
    rows += [(None, texts[-1], "en", "a"), (None, texts[-1], "en", "a"), (None, None, "en", None)]
    told = [(rng.randrange(160), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    want = brute([(k, t, s) for k, t, _, s in rows], told)
    assert audited(documents(rows), labels(told)) == want
    assert len({k[0] for k in want}) == 4 and len(want) == 4 * 600


def test_ties_of_words_and_capitals(documents, labels):
    """Exactly 200 words, exactly half distinct, exactly 2 % capitals pass."""
    half = " ".join(f"w{i % 100}" for i in range(200))
    two = "A" + "b" * 49
    rows = [(1, half, "en", "s"), (2, two, "en", "s"), (3, two + " C", "en", "s"), (4, half + " w0", "en", "s")]
    got = dict(zip([1, 2, 3, 4], [f for _, f in failures([(k, t, s) for k, t, _, s in rows])], strict=True))
    assert got == {1: set(), 2: {"A"}, 3: {"A", "C"}, 4: {"B"}}
    assert audited(documents(rows), labels([])) == brute([(k, t, s) for k, t, _, s in rows], [])


def test_awkward_rows_and_empty_tables(awkward, documents, labels):
    told = [(5, 1, 0), (5, 1, 1), (6, 0, 1), (8, 1, 1), (None, 1, 1)]
    rows = [(r.doc_id, r.text, r.source) for r in awkward.collect()]
    assert audited(awkward, labels(told).withColumn("_row", F.lit("clash"))) == brute(rows, told)
    assert audited(documents([]), labels(told)) == {}


def test_one_hot_group_of_copies(documents, labels):
    rows = [(i, "copy of copies" if i % 3 else f"text {i}", "en", "hot") for i in range(900)]
    assert audited(documents(rows), labels([(1, 1, 1)])) == brute([(k, t, s) for k, t, _, s in rows], [(1, 1, 1)])


def test_any_tables_of_ids(spark):
    rows = spark.range(8).select(
        F.col("id").alias("_row"), F.lit("p").alias("_part"), (F.col("id") == 3).alias("_good"), F.lit(False).alias("_toxic")
    )
    ids = lambda *xs: spark.createDataFrame([(x,) for x in xs], "_row long")
    outcome = audit.outcomes(rows, {"x": ids(1, 1, 3), "y": ids(3, 4, 99)})
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.good_lost) for r in audit.interactions(outcome, ["x", "y"]).collect()}
    assert got == {("xy", 1): (6, 2, 0, 1), ("xy", 2): (5, 1, 1, 0), ("yx", 1): (6, 2, 0, 1), ("yx", 2): (5, 1, 1, 0)}
    with pytest.raises(ValueError, match="at most"):
        audit.interactions(outcome, list("abcdefg"))
