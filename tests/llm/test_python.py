"""Token counts, toxicity, WARC archives and nearest neighbours."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from textsentry.llm import neighbours, queries, tokens, toxicity, warc
from textsentry.llm.queries import tokenizer_path


def test_counts_equal_the_library(documents):
    model = tokens.load_model(tokenizer_path())
    assert tokens.splits_safely(model)
    rng = random.Random(3)
    pieces = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "漢字", "　", "<s>", "</s>", "ing", "\x00", "ﬁ", ". "]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += [None, "", " ", "x" * 5000, " ".join(["word"] * 50_000), "\n".join(texts)]
    got = tokens.token_lengths(documents(list(enumerate(texts))), "doc_id", "text", tokenizer_path()).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or ""))) for i, t in enumerate(texts)]
    assert sorted(tuple(r) for r in got) == want


def test_unsafe_models_encode_whole_texts():
    seen = []

    def encode(texts):
        seen.extend(texts)
        return [list(t) for t in texts]

    assert tokens.Counter(encode, False).count(["a b", "", "c"]) == [3, 0, 1]
    assert sorted(seen) == ["", "a b", "c"]


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 10)
    sizes = []

    def encode(texts):
        sizes.append(sum(map(len, texts)))
        return [list(t) for t in texts]

    tokens.Counter(encode, True).count([" ".join(f"w{i}" for i in range(50))])
    assert max(sizes) <= 13 and len(sizes) > 5
    assert [len(b) for b in tokens.by_bytes(["aaaa"] * 5 + ["b" * 50], 10)] == [2, 2, 1, 1]


def test_counts_of_awkward_rows(awkward, documents):
    got = tokens.token_lengths(awkward, "doc_id", "text", tokenizer_path()).collect()
    assert len(got) == 11 and sum(r.n_tokens == 0 for r in got) == 3
    assert tokens.token_lengths(documents([]), "doc_id", "text", tokenizer_path()).collect() == []


def abusive(rng, k=30):
    """Words with stems 'vex-' and the word 'clod' in toxic texts only."""
    base = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in ["", "na", "sto", "rin"]]
    say = [rng.choice(base) for _ in range(k)]
    clean = " ".join(say)
    for _ in range(3):
        say.insert(rng.randrange(len(say)), rng.choice(["clod", "vexil" + rng.choice(base), "Vexil" + rng.choice(base)]))
    return clean, " ".join(say)


@pytest.fixture(scope="module")
def field():
    rng = random.Random(5)
    pairs = [abusive(rng) for _ in range(150)]
    return toxicity.fit([t for _, t in pairs] + [c for c, _ in pairs], [True] * 150 + [False] * 150)


def test_held_out_accuracy_and_spans(field):
    rng = random.Random(6)
    pairs = [abusive(rng, 200) for _ in range(100)]
    tagger = toxicity.Tagger(field)
    bad, spans = tagger.tag([t for _, t in pairs], toxicity.THRESHOLD)
    good, none = tagger.tag([c for c, _ in pairs], toxicity.THRESHOLD)
    assert np.mean(np.array(bad) >= toxicity.THRESHOLD) >= 0.97
    assert np.mean(np.array(good) < toxicity.THRESHOLD) >= 0.97
    words = [t[s["start"] : s["end"]] for (_, t), found in zip(pairs, spans, strict=True) for s in found]
    hits = [all(w.lower() == "clod" or w.lower().startswith("vexil") for w in x.split()) for x in words]
    assert np.mean(hits) >= 0.97 and len(words) >= 250


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    step = np.exp(rng.normal(size=4))
    lengths = np.array([5, 3, 1])
    odds = np.ones((5, 3))
    for k, n in enumerate(lengths):
        odds[:n, k] = np.exp(rng.normal(size=n))
    got = toxicity.marginals(odds, lengths, step)
    for k, n in enumerate(lengths):
        weight = np.zeros((n, 2))
        for path in range(2**n):
            y = [path >> i & 1 for i in range(n)]
            w = np.prod([odds[i, k] for i in range(n) if y[i]]) * np.prod([step[2 * a + b] for a, b in zip(y, y[1:], strict=False)])
            for i in range(n):
                weight[i, y[i]] += w
        np.testing.assert_allclose(got[:n, k], weight[:, 1] / weight.sum(1))


def test_learning_leaves_held_out_labels_alone(spark, documents):
    rng = random.Random(8)
    docs = documents([(i, abusive(rng)[i % 2]) for i in range(40)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    known = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted((r["_id"], r["_toxic"]) for r in rows) == [(i, i % 2) for i in known]


def test_toxicity_of_awkward_rows(spark, awkward, documents, field):
    tagged = toxicity.tag_documents(awkward, field)
    assert set(tagged.columns) == {*awkward.columns, "toxic_spans"}
    rows = tagged.collect()
    assert len(rows) == 11 and all(0 <= r.toxic_score < 0.3 and r.toxic_spans == [] for r in rows if not r.text)
    nothing = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_clean(awkward, nothing)  # nothing to learn from: nothing is toxic
    assert kept.count() == 11
    assert toxicity.tag_documents(documents([]), field).collect() == []


PAGES = "page_id long, url string, html string"


def round_trip(pages, path, revisit_from=0):
    warc.write_archives(warc.records(pages, "page_id", "url", "html", 10_000, revisit_from), path)
    return warc.reassemble(warc.read_records(pages.sparkSession, path))


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 700)
    monkeypatch.setattr(warc, "CHUNK_BYTES", 64)
    nasty = "x\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n0\r\n\r\n"
    bodies = ["", None, nasty, nasty * 200, "漢字é" * 900, "tail\r\n", "a" * 700, "\r\n\r\n", "same", "same", nasty * 200, "lone \x00"]
    rows = [(100 - i, f"http://h/{i}\r\nX: y" if i % 2 else None, b) for i, b in enumerate(bodies)] + [(None, "u", "gone")]
    pages = spark.createDataFrame(rows, PAGES).repartition(4)
    back = round_trip(pages, f"{tmp_path}/w")
    got = {r.page_id: r for r in back.collect()}
    first = {}
    for i, b in enumerate(bodies):
        first[b or ""] = 100 - i  # ids fall, so the last one seen is the least
    for i, b in enumerate(bodies):
        r, payload = got.pop(100 - i), (b or "").encode()
        assert r.valid and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if first[b or ""] == 100 - i:
            assert (r.kind, bytes(r.payload), r.refers_to) == ("response", payload, None)
        else:
            assert (r.kind, r.payload, r.refers_to) == ("revisit", None, first[b or ""])
    assert not got
    sizes = {r.page_id: r.payload_bytes for r in warc.resolve(back).collect()}
    assert sizes == {100 - i: len((b or "").encode()) for i, b in enumerate(bodies)}


def test_repeated_and_null_ids(spark, tmp_path, monkeypatch):
    """One result row for each page: equal rows, one id with two bodies, rows without an id."""
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 100)
    long, other = "z" * 1000, "y" * 500
    rows = [(1, long), (1, long), (2, "ab"), (2, "ab"), (3, "ab"), (4, long), (5, "one"), (5, "ab"), (6, "one"), (5, other)]
    rows += [(None, long), (None, "ab"), (None, "alone"), (None, "alone"), (None, other * 2), (None, other * 2), (None, None)]
    pages = spark.createDataFrame([(i, f"u{k}", b) for k, (i, b) in enumerate(rows)], PAGES).repartition(4)
    warc.write_archives(warc.records(pages, "page_id", "url", "html", 10_000, null_ids=True), f"{tmp_path}/w")
    back = warc.reassemble(warc.read_records(spark, f"{tmp_path}/w"))
    least = {}
    for i, b in rows:
        least[b] = min([x for x in (i, least.get(b)) if x is not None], default=None)
    want = Counter()
    for i, b in rows:
        revisit = least[b] is not None and i != least[b]
        sha = base64.b32encode(hashlib.sha1((b or "").encode()).digest()).decode()
        want[i, len(b or ""), sha, "revisit" if revisit else "response", least[b] if revisit else None, True] += 1
    assert Counter(tuple(r) for r in warc.resolve(back).collect()) == want
    pages.write.parquet(f"{tmp_path}/in/pages.parquet")
    assert Counter(tuple(r) for r in queries.op9_warc(spark, f"{tmp_path}/in").collect()) == want
    archived = {bytes(r.payload) for r in back.where("kind = 'response'").collect()}
    assert archived == {(b or "").encode() for _, b in rows}


def test_short_payloads_are_not_revisited(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES)
    got = {r.page_id: r.kind for r in round_trip(pages, f"{tmp_path}/w", revisit_from=3).collect()}
    assert got == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_lost_and_damaged_segments_are_noticed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT_BYTES", 100)
    pages = spark.createDataFrame([(1, "u", "z" * 1000), (2, "u", "y" * 1000)], PAGES)
    path = f"{tmp_path}/w"
    warc.write_archives(warc.records(pages, "page_id", "url", "html", 2000), path)
    recs = warc.read_records(spark, path)
    for damaged in (recs.where("NOT (origin = 1 AND segment = 3)"), recs.withColumn("total", F.when(F.col("origin") == 1, 7).otherwise(F.col("total")))):
        got = {r.page_id: (r.valid, r.payload) for r in warc.reassemble(damaged).collect()}
        assert got[1] == (False, None) and got[2][0]
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\n\r\n"))


def test_no_pages(spark, tmp_path):
    assert round_trip(spark.createDataFrame([], PAGES), f"{tmp_path}/w").collect() == []


VECTORS = "vec_id long, embedding array<float>, label int"


def brute_nearest(rows, k=5, step=50):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(np.float64)
    out = {}
    for i, q in rows:
        if i % step == 0:
            score = neighbours.cosines(np.array(q, np.float32).astype(np.float64), x)
            best = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_all_entries_visited_is_exact(spark):
    """With every cell visited only ties and scores can differ; many vectors are equal."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 6)).round(1)
    rows = [(i, base[rng.integers(40)].tolist()) for i in range(600)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5)
    assert found(neighbours.nearest(df, "vec_id", "embedding", share=1.0)) == brute_nearest(rows)


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(3000, 16)))]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    got, want = found(neighbours.nearest(df, "vec_id", "embedding", entries=100)), brute_nearest(rows)
    recall = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 5 for q in want])
    assert recall >= 0.9
    assert all(dict(want[q]).get(a, s) == s for q in want for a, s in got[q])


def test_split_cells_and_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP", 50)
    monkeypatch.setattr(neighbours, "BLOCK", 4)
    rng = np.random.default_rng(4)
    rows = [(i, (np.array([1, 1, 0, 0]) + rng.normal(size=4) * 0.01).tolist()) for i in range(700)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)
    assert found(neighbours.nearest(df, "vec_id", "embedding", share=1.0)) == brute_nearest(rows)


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [0.0, 1.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [None, 1.0]), (5, [inf, 1.0]),
            (6, []), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (8, [1.0, 1.0]), (8, [1.0, 1.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumn("_cell", F.lit("clash"))
    got = found(neighbours.nearest(df, "vec_id", "embedding"))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [8, 50], 50: [8, 0]}
    assert neighbours.nearest(df.where("vec_id IN (1, 2)"), "vec_id", "embedding").collect() == []
