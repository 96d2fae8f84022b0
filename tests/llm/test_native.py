"""Decontamination, sharding and mixing: plans without Python, brute force and awkward rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from textsentry.llm import decontamination, mixing, sharding
from textsentry.llm.common import seeded_key

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PYTHON = re.compile("Python|Pandas|Arrow")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute_hits(docs, items, window=13):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows[tuple(w[i : i + k])].add(item)
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit.update(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        out.append((key, len(w), len(hit), sorted(found)))
    return sorted(out)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def bench(spark):
    return lambda rows: spark.createDataFrame(rows, "item_id long, text string")


def test_hits_equal_brute_force(documents, bench):
    rng = random.Random(7)
    vocabulary = ["Ab", "cd", "É", "é", "K", "k", "İx", "e1", "f", "漢"]
    say = lambda k: rng.choice([" ", ", ", "--"]).join(rng.choice(vocabulary) for _ in range(k))
    items = [(i, say(rng.choice([1, 3, 5, 13, 20]))) for i in range(12)]
    items += [(20, items[0][1]), (21, None), (22, "..."), (23, say(30))]
    docs = []
    for i in range(60):
        parts = [say(rng.randint(0, 25)), rng.choice(items)[1] or "", say(rng.randint(0, 25))]
        docs.append((i, " ".join(parts).swapcase() if i % 3 == 0 else " ".join(parts)))
    docs += [(100, None), (101, ""), (102, "...")]
    got = decontamination.hits_by_document(documents(docs), bench(items)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, sorted(r.items)) for r in got) == brute_hits(docs, items)


def test_letters_whose_lower_case_depends_on_others(documents, bench):
    """A capital sigma is lowered by what surrounds it, across the ends of words; such texts still hit."""
    tail = " α β γ δ ε ζ η θ ι κ λ μ"
    items = [(1, "ΣΕΙΣΜΟΣ:ΑΘΗΝΑ" + tail), (2, "Δ.Σ." + tail), (3, "ΟΔΟΣ"), (4, "σ"), (5, "ς")]
    docs = [(i, f"x {text} y") for i, text in items] + [(9, "Δ.Σ."), (10, "ΟΔΟΣ^Α ΟΔΟΣ"), (11, "οδος οδοσ"), (12, "Δ Σ" + tail)]
    got = decontamination.hits_by_document(documents(docs), bench(items)).collect()
    want = brute_hits(docs, items)
    assert sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in got) == want
    assert [w[3] for w in want][:2] == [[1], [2]]


def test_shuffled_joins_give_the_same(documents, bench, monkeypatch):
    items = [(1, " ".join(f"w{i}" for i in range(20)))]
    docs = [(1, "x " + items[0][1] + " y"), (2, "w1 w2 w3")]
    want = decontamination.hits_by_document(documents(docs), bench(items)).collect()
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(decontamination.hits_by_document(documents(docs), bench(items)).collect()) == sorted(want)


def test_no_items_and_no_documents(documents, bench):
    docs = documents([(1, "some words"), (2, None)])
    got = sorted((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in decontamination.hits_by_document(docs, bench([])).collect())
    assert got == [(1, 2, 0, []), (2, 0, 0, [])]
    assert decontamination.hits_by_document(documents([]), bench([(1, "a b")])).collect() == []


def test_contaminated_rows_go(awkward, documents, bench):
    items = bench([(1, "same text in two rows and more"), (None, "one")])
    kept = decontamination.decontaminate(awkward, items)
    assert kept.columns == awkward.columns
    assert Counter(r.doc_id for r in kept.select("doc_id").collect()) == Counter([1, 2, 3, 7, 8, None, None])
    # One hit word in twenty is enough, one in twenty-one is not.
    some = documents([(1, "hit " + "x " * 19), (2, "hit " + "x " * 20)])
    assert [r.doc_id for r in decontamination.decontaminate(some, bench([(1, "hit")])).collect()] == [2]


def test_native_plans(awkward, bench):
    for df in (
        decontamination.hits_by_document(awkward, bench([(1, "a b c")])),
        sharding.shard_documents(awkward),
        mixing.mix_documents(awkward),
    ):
        assert not PYTHON.search(plan(df))


def test_shards_are_even_and_match_the_mixture(documents):
    rng = random.Random(1)
    rows = [(i, f"text {i}", "en", rng.choice(["big"] * 6 + ["mid"] * 3 + ["small"])) for i in range(1003)]
    placed = sharding.shard_documents(documents(rows)).collect()
    shards = defaultdict(list)
    for r in placed:
        shards[r.shard].append(r)
    assert set(shards) == set(range(16))
    sizes = [len(s) for s in shards.values()]
    assert max(sizes) - min(sizes) <= 1
    totals = Counter(r.source for r in placed)
    for s in shards.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
        for source, n in Counter(r.source for r in s).items():
            assert abs(n - totals[source] / 16) <= 2
    again = sharding.shard_documents(documents(rows, parts=7)).collect()
    assert sorted(again) == sorted(placed)
    assert sorted(sharding.shard_documents(documents(rows), seed="other").collect()) != sorted(placed)


def test_sharding_awkward_rows(awkward, documents):
    placed = sharding.shard_documents(awkward).collect()
    assert len(placed) == 11 and len({(r.shard, r.slot) for r in placed}) == 11
    one = next(r for r in placed if r.doc_id == 4)
    assert (one.size, one.text_crc32) == (4, zlib.crc32(b"one"))
    assert all((r.size, r.text_crc32) == (1, 0) for r in placed if r.doc_id in (1, 2))
    assert sharding.shard_documents(documents([])).collect() == []


def fill(budget, children):
    """Reference: children (weight, capacity) filled in rounds, shortage to the siblings."""
    got = [0.0] * len(children)
    left, live = float(budget), [i for i, (w, c) in enumerate(children) if w and c]
    while live and left > 1e-9:
        total = sum(children[i][0] for i in live)
        full = [i for i in live if left * children[i][0] / total >= children[i][1]]
        if not full:
            for i in live:
                got[i] = left * children[i][0] / total
            return got
        for i in full:
            got[i] = children[i][1]
            left -= children[i][1]
            live.remove(i)
    return got


def test_shortages_go_to_siblings_first(spark):
    rows = [("a", "x", "1", 100), ("a", "x", "2", 1000), ("a", "y", "3", 50), ("b", "x", "4", 5000), ("b", None, None, 0)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, supply long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(leaves, list(mixing.TREE), {("a",): 3}, 0.3, 1).collect()}
    budget = int(sum(r[3] for r in rows) * 0.3)
    a, b = fill(budget, [(3, 1150), (1, 5000)])
    ax, ay = fill(int(a), [(1, 1100), (1, 50)])
    a1, a2 = fill(int(ax), [(1, 100), (1, 1000)])
    for key, want in {("a", "x", "1"): a1, ("a", "x", "2"): a2, ("a", "y", "3"): ay, ("b", "x", "4"): int(b), ("b", None, None): 0}.items():
        assert abs(got[key] - want) <= 2
    assert sum(got.values()) <= budget and budget - sum(got.values()) <= 6


def test_prefixes_in_seeded_epochs(spark):
    """A leaf read one and a half times: every row once, then a prefix of the second epoch's order."""
    rows = [(i, "d", "l", "s", 10) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n long").repartition(5)
    taken = mixing.mix(docs, "doc_id", "n", weights={}, share=1.5, epochs=2).collect()
    times = Counter(r.doc_id for r in taken)
    assert sum(times.values()) == 150 and set(times.values()) == {1, 2}
    order = [r.doc_id for r in docs.orderBy(seeded_key(mixing.SEED, F.lit(2), F.col("doc_id"))).select("doc_id").collect()]
    assert {k for k, v in times.items() if v == 2} == set(order[:50])
    assert all(r.cum_tokens <= 1000 for r in taken)


def test_mixing_awkward_rows(awkward, documents):
    rows = mixing.mix_documents(awkward, share=1.0, epochs=1).collect()
    assert len(rows) == 7  # all rows of leaves that have tokens
    kept = mixing.take_mix(awkward, share=0.6)
    assert kept.columns == awkward.columns and kept.count() < 11
    assert mixing.mix_documents(documents([])).collect() == []


def test_rows_are_taken_one_by_one(documents):
    """Rows that share an id or have none do not come together beyond the budget."""
    for rows in ([(None, f"w{i} x y z") for i in range(40)], [(1, "a b c d")] * 40, [(i % 4, f"w{i} x y z") for i in range(40)]):
        assert mixing.take_mix(documents(rows), share=0.5).count() == 20
    two = [(1, "a b c d", "en", "src1")] * 10 + [(1, "a b c d", "en", "src2")] * 10
    assert Counter(r.source for r in mixing.take_mix(documents(two), share=0.5).collect()) == {"src1": 5, "src2": 5}


def _fullest(monkeypatch, module):
    """Rows of the fullest window partition each running total of ``module`` makes."""
    seen = []
    plain = module.running_total

    def measured(df, groups, bucket, *rest):
        seen.append(df.groupBy(*groups, bucket).count().agg(F.max("count")).first()[0])
        return plain(df, groups, bucket, *rest)

    monkeypatch.setattr(module, "running_total", measured)
    return seen


@pytest.mark.parametrize("kind", ["null ids", "one id, one text", "single-row sources", "null ids in single-row sources"])
def test_sharding_splits_hot_buckets(spark, monkeypatch, kind):
    seen = _fullest(monkeypatch, sharding)
    n = 40_000
    docs = spark.range(n).select(
        (F.col("id") if kind == "single-row sources" else F.lit(7 if "one id" in kind else None)).cast("long").alias("doc_id"),
        F.concat(F.lit("text "), F.lit("") if "one text" in kind else F.col("id")).alias("text"),
        (F.col("id").cast("string") if "single-row" in kind else F.lit("src")).alias("source"),
    )
    out = sharding.shard_documents(docs).groupBy("shard").agg(
        F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last")
    )
    rows = out.collect()
    assert len(rows) == 16 and all(r["n"] == r["slots"] == r["last"] + 1 == n // 16 for r in rows)
    assert max(seen) < 6_000


def test_mixing_splits_hot_buckets(spark):
    n = 30_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 != 0, F.col("id")).alias("id"), F.lit("d").alias("domain"), F.lit("en").alias("lang"),
        F.lit("s").alias("source"), F.lit(2).cast("long").alias("t"),
    )
    out = mixing.mix(rows, "id", "t", share=0.5, epochs=1)
    sums = out.agg(F.count("*").alias("n"), F.countDistinct("cum_tokens").alias("places"), F.max("cum_tokens").alias("last")).first()
    assert (sums["n"], sums["places"], sums["last"]) == (n // 2, n // 2, n)
    held = out.where("id IS NULL").count()
    assert 0 <= held <= n // 3
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not PYTHON.search(plan)
