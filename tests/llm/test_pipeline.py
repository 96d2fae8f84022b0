"""The pipeline's stages, each against a plain version on its own input, and the registered queries."""

import hashlib
import re
from collections import defaultdict

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from test_dedup import brute_bytes, brute_components, brute_words
from test_native import brute_hits, fill
from textsentry.llm import decontamination, mixing, toxicity
from textsentry.llm.common import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The rows before the first stage and after each one."""
    folder = tmp_path_factory.mktemp("stages")
    docs = table(spark, SF, "documents")
    out = [[tuple(r) for r in docs.collect()]]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append([r.asDict() for r in docs.collect()] if name == "sharding" else [tuple(r) for r in docs.collect()])
    return out


def ids(rows):
    return sorted(r[0] for r in rows)


def test_columns_and_repeatability(spark, stages):
    columns = table(spark, SF, "documents").columns
    assert all(len(r) == len(columns) for rows in stages[:5] for r in rows)
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted(tuple(r) for r in again) == sorted(tuple(r.values()) for r in stages[5])


def test_toxicity_stage(spark, stages):
    docs = table(spark, SF, "documents")
    model = toxicity.learn(docs, table(spark, SF, "labels"))
    scores, _ = toxicity.Tagger(model).tag([r[1] or "" for r in stages[0]], 0.3)
    assert ids(stages[1]) == sorted(r[0] for r, s in zip(stages[0], scores, strict=True) if s < toxicity.THRESHOLD)


def test_near_dedup_stage(stages):
    root = brute_components([(r[0], r[1]) for r in stages[1]], 5)
    assert ids(stages[2]) == sorted(k for k, _, c in root if k == c)


def test_decontamination_stage(spark, stages):
    items = [tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()]
    hits = brute_hits([(r[0], r[1]) for r in stages[2]], items)
    assert ids(stages[3]) == sorted(k for k, n, hit, _ in hits if not (hit and decontamination.HIT_SHARE * hit >= n))


def test_mixing_stage(stages):
    def domain(source):
        number = re.search("([0-9]+)$", source)
        n = int(number[1]) if number else None
        return "other" if n is None else "web" if n == 0 else "books" if n < 10 else "reference"

    leaves, tokens = defaultdict(list), {}
    for doc_id, text, lang, source, _ in stages[3]:
        leaves[domain(source), lang, source].append(doc_id)
        tokens[doc_id] = len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    supply = {k: sum(tokens[d] for d in v) for k, v in leaves.items()}

    def split(budget, prefix):
        depth = len(prefix)
        if depth == 3:
            return {prefix: budget}
        names = sorted({k[depth] for k in supply if k[:depth] == prefix})
        caps = [sum(v for k, v in supply.items() if k[: depth + 1] == (*prefix, n)) for n in names]
        parts = fill(budget, [(mixing.WEIGHTS.get((*prefix, n), 1), c) for n, c in zip(names, caps, strict=True)])
        return {k: v for n, p in zip(names, parts, strict=True) for k, v in split(int(p + 1e-6), (*prefix, n)).items()}

    plan = split(int(sum(supply.values()) * mixing.SHARE), ())
    want = []
    for leaf, docs in leaves.items():
        total = 0
        for d in sorted(docs, key=lambda d: hashlib.md5(f"{mixing.SEED}|1|{d}".encode()).hexdigest()):
            total += tokens[d]
            if plan[leaf] and total <= plan[leaf]:
                want.append(d)
    assert len(want) > 20 and ids(stages[4]) == sorted(want)


def test_sharding_stage(stages):
    placed = stages[5]
    assert sorted(r["doc_id"] for r in placed) == ids(stages[4])
    by_source = defaultdict(list)
    for r in placed:
        by_source[r["source"]].append(r["doc_id"])
    key = lambda d: hashlib.md5(f"shard|{d}".encode()).hexdigest()
    at = []
    for source, docs in by_source.items():
        for k, d in enumerate(sorted(docs, key=key)):
            at.append(((k + 0.5) / len(docs), key(d), source, d))
    n = len(at)
    want = {d: (i * 16 // n, i - -(-(i * 16 // n) * n // 16)) for i, (_, _, _, d) in enumerate(sorted(at))}
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in placed} == want


def test_every_operator_has_one_query():
    names = [q for q in entry.queries() if q.startswith("op")]
    assert sorted(int(q[2:].split("_")[0]) for q in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_whole_tables_against_brute_force(spark):
    rows = [(r.doc_id, r.text or "") for r in table(spark, SF, "documents").collect()]
    got = entry.queries()["op1_suffix_dedup"](spark, SF).collect()
    assert sorted(tuple(r) for r in got) == brute_bytes([(k, t.encode()) for k, t in rows], 200)
    got = entry.queries()["op7_substring_dedup"](spark, SF).collect()
    want = [(k, n, d, hashlib.sha256(t.encode()).hexdigest()) for k, n, d, t in brute_words(rows, 20)]
    assert sorted(tuple(r) for r in got) == want
    got = entry.queries()["op5_near_dedup"](spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(tuple(r) for r in got) == brute_components(rows, 2)
