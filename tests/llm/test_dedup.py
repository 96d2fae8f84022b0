"""Exact substring dedup (bytes and words) and near-duplicates against brute force."""

import hashlib
import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from textsentry.llm import minhash, queries, repeats, substrings, suffixes
from textsentry.llm import symbols as S

SPACE = r"[^\x20\x09-\x0D]+"


def brute_bytes(docs, window):
    seen = Counter(t[i : i + window] for _, t in docs for i in range(len(t) - window + 1))
    out = []
    for key, text in docs:
        drop = [False] * len(text)
        for i in range(len(text) - window + 1):
            if seen[text[i : i + window]] > 1:
                drop[i : i + window] = [True] * window
        kept = bytes(c for c, d in zip(text, drop, strict=True) if not d)
        spans = len(re.findall("1+", "".join("01"[d] for d in drop)))
        out.append((key, len(text), sum(drop), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def brute_words(docs, window):
    seen, out = set(), []
    for key, text in sorted(docs):
        words = re.findall(SPACE, text)
        drop = [False] * len(words)
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                drop[i : i + window] = [True] * window
            seen.add(run)
        kept = " ".join(w for w, d in zip(words, drop, strict=True) if not d)
        out.append((key, len(words), sum(drop), kept))
    return out


def corpus(seed, n=60):
    """Texts of a small vocabulary with shared passages, edits, runs and periods."""
    rng = random.Random(seed)
    words = ["a", "bb", "ü", "the", "漢字", "x", "long-word"]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(40) for _ in range(4)]
    texts = []
    for i in range(n):
        text = " ".join([say(rng.randint(0, 30)), rng.choice(shared), say(rng.randint(0, 30))])
        texts.append(rng.choice([text, text[: rng.randint(0, len(text))], "z" * rng.randint(0, 300), "ab " * 60, rng.choice(texts or [text])]))
    return list(enumerate(texts))


@pytest.mark.parametrize("seed, longer", [(1, 64), (2, 64), (1, 0), (2, 0), (6, 0)])
def test_bytes_equal_brute_force(documents, monkeypatch, seed, longer):
    """Also with windows narrowed by the surroundings their grams share."""
    monkeypatch.setattr(repeats, "LONGER", longer)
    docs = corpus(seed)
    got = suffixes.dedup_bytes(documents(docs), "doc_id", "text", window=40, gram=10).collect()
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got)
    assert rows == brute_bytes([(k, t.encode()) for k, t in docs], 40)
    for r in got:
        text = dict(docs)[r.doc_id].encode()
        for s in reversed(r.spans):
            text = text[: s.start] + text[s.start + s.length :]
        assert text == bytes(r.kept)


@pytest.mark.parametrize("seed", [3, 4])
def test_words_equal_brute_force(documents, seed):
    docs = corpus(seed)
    got = substrings.dedup_substrings(documents(docs), "doc_id", "text", window=8, gram=3).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got) == brute_words(docs, 8)
    assert all(sum(s.words for s in r.removed) == r.n_removed for r in got)
    assert all(r.kept_sha256 == hashlib.sha256(r.kept_text.encode()).hexdigest() for r in got)


def test_texts_longer_than_a_buffer(documents, monkeypatch):
    """Pieces of long texts overlap by a window; nothing is lost or doubled where they meet."""
    monkeypatch.setattr(S, "BUFFER", 256)
    docs = [(k, t * 5) for k, t in corpus(5, 12)]
    scheme = S.Scheme(False, 40, 10)
    data = np.frombuffer(b"".join(t.encode() for _, t in docs), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for _, t in docs])
    starts = Counter()
    for buffer in S.buffers(scheme, data, offsets, 40):
        a = S.anchors(scheme, buffer)
        starts.update((r, i) for r, lo, n in zip(a.row, a.lo, a.n, strict=True) for i in range(lo, lo + n))
    want = {(k, i) for k, (_, t) in enumerate(docs) for i in range(len(t.encode()) - 39)}
    assert set(starts) == want
    assert set(starts.values()) == {1}


def test_words_longer_than_a_buffer(monkeypatch):
    monkeypatch.setattr(S, "BUFFER", 64)
    text = ("x" * 100 + " y " + "x" * 100 + " yy").encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, _ = S.word_bounds(data, np.array([0, len(data)]))
    symbols = S.word_symbols(data, starts, ends)
    assert symbols[0] == symbols[2] and len(set(symbols.tolist())) == 3


def two_words_alike(n=1024):
    """Two Thue-Morse words: their polynomials agree modulo 2**64 for every odd base."""
    ones = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in ones), "".join("ba"[x] for x in ones)


def test_words_whose_polynomials_agree(documents):
    one, other = two_words_alike()
    rest = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{one} {rest}"), (2, f"{other} {rest}"), (3, one), (4, other), (5, one)]
    cut = {r.doc_id: r.n_removed for r in substrings.dedup_substrings(documents(rows), "doc_id", "text").collect()}
    assert cut == {k: 0 for k in range(1, 6)}
    found = minhash.near_duplicates(documents(rows), "doc_id", "text", 2).collect()
    want = brute_components(rows, 2)
    assert sorted((r["_key"], r.n_shingles, r.component) for r in found) == want
    assert [c for _, _, c in want][2:] == [3, 4, 3]
    # Bytes: the two words in different surroundings repeat nothing but what they really share.
    texts = [(1, one + "1" * 30), (2, "2" * 30 + other), (3, one[:700])]
    got = suffixes.dedup_bytes(documents(texts), "doc_id", "text").collect()
    rows = sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got)
    assert rows == brute_bytes([(k, t.encode()) for k, t in texts], 200)


def test_a_hot_group_of_near_copies(documents):
    """Hundreds of edits of one text, whose pairs lie on both sides of the threshold."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(120)] = f"x{rng.randrange(3000)}"
        rows.append((i, " ".join(text)))
    rows += [(1000 + i, " ".join(f"y{rng.randrange(90)}" for _ in range(50))) for i in range(100)]
    found = minhash.near_duplicates(documents(rows), "doc_id", "text", 2)
    assert sorted((r["_key"], r.n_shingles, r.component) for r in found.collect()) == brute_components(rows, 2)


def test_the_last_pass_alone_finds_all_links(documents, monkeypatch):
    monkeypatch.setattr(minhash, "meetings", lambda posts: posts.select(F.col("rep").alias("u"), F.col("rep").alias("v")).where("u != v"))
    docs = [(k, t) for k, t in corpus(12, 40)]
    found = minhash.near_duplicates(documents(docs), "doc_id", "text", 2)
    assert sorted((r["_key"], r.n_shingles, r.component) for r in found.collect()) == brute_components(docs, 2)


def test_awkward_rows(awkward):
    cut = {}
    for r in suffixes.dedup_bytes(awkward, "doc_id", "text").collect():
        cut.setdefault(r.doc_id, []).append(r)
    assert cut[1][0].n_bytes == cut[2][0].n_bytes == 0
    assert cut[7][0].n_removed == cut[7][0].n_bytes == cut[8][0].n_removed  # long copies
    assert len(cut[5]) == 2 and len(cut[None]) == 2  # every row has its result
    words = {}
    for r in substrings.dedup_substrings(awkward, "doc_id", "text").collect():
        words.setdefault(r.doc_id, []).append(r)
    assert words[8][0].n_removed == words[8][0].n_words == 80_000  # the later copy goes
    assert words[7][0].n_removed < 80_000
    assert words[3][0].n_words == 0 and words[4][0].kept_text == "one"


@pytest.mark.parametrize("call", [suffixes.dedup_bytes, substrings.dedup_substrings, minhash.near_duplicates])
def test_empty_table(documents, call):
    assert call(documents([]), "doc_id", "text").collect() == []


def shingles(text, size):
    words = re.findall(SPACE, "".join(c.lower() if c < "\x80" else c for c in text))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} or ({tuple(words)} if words else set())


def brute_components(docs, size):
    sets = {k: shingles(t or "", size) for k, t in docs}
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((k, len(sets[k]), find(k)) for k in keys)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_brute_force(documents, size):
    """Families of edited copies, chains that drift, exact copies, short texts."""
    rng = random.Random(size)
    vocabulary = [f"w{i}" for i in range(500)]
    docs = []
    for family in range(8):
        text = [rng.choice(vocabulary) for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(12):
            if rng.random() < 0.3:
                docs.append(" ".join(text).upper())
            at = rng.randrange(len(text))
            text = [*text[:at], rng.choice(vocabulary), *text[at + 1 :]]
            docs.append(" ".join(text))
    docs += ["", None, "one", "ONE", "two  words", "Two words", "É one", "é one"]
    rows = list(enumerate(docs))
    found = minhash.near_duplicates(documents(rows), "doc_id", "text", size)
    got = sorted((r["_key"], r.n_shingles, r.component) for r in found.collect())
    assert got == brute_components(rows, size)


def test_near_duplicates_of_awkward_rows(awkward):
    found = minhash.near_duplicates(awkward, "doc_id", "text")
    component = {(r["_key"].id, r["_key"].hash): r.component.id for r in found.collect()}
    named = {k[0]: v for k, v in component.items()}
    assert named[6] == 5 and named[8] == 7 and named[1] == 1 and named[2] == 2
    kept = minhash.keep_one(awkward, "doc_id", "text")
    assert kept.columns == awkward.columns
    assert sorted(r.doc_id or 0 for r in kept.select("doc_id").collect()) == [0, 0, 1, 2, 3, 4, 5, 5, 7]


def test_one_row_of_each_group_stays(spark, documents, tmp_path):
    """Repeated rows and rows without an id; a row with an id goes before one without."""
    a, b = "one two three four five six seven", "another text of a few more words"
    rows = [(9, a), (None, a), (None, a), (5, b), (5, b), (6, b), (None, "c d e f"), (None, "c d e f"), (7, "c"), (7, "d"), (None, None), (None, "")]
    kept = minhash.keep_one(documents(rows), "doc_id", "text", copies=False)
    got = Counter((r.doc_id, r.text or "") for r in kept.collect())
    assert got == Counter([(9, a), (5, b), (None, "c d e f"), (7, "c"), (7, "d"), (None, "")])
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    staged = corpus_pipeline.near_dedup_stage(spark, documents(rows), str(tmp_path))
    assert Counter((r.doc_id, r.text or "") for r in staged.collect()) == got
    found = queries.op5_near_dedup(spark, str(tmp_path)).collect()
    assert len(found) == len(rows) and sum(r.kept for r in found) == len(got)
    assert {r.component_id for r in found if r.doc_id == 9} == {9}
    assert sorted(r.component_id or 0 for r in found) == [0, 0, 0, 0, 5, 5, 5, 7, 7, 9, 9, 9]


def test_components_of_chains_and_stars(spark):
    from textsentry.llm.components import components

    chain = [(i, i + 1) for i in range(100, 140)]
    star = [(5, i) for i in range(10, 30)]
    links = spark.createDataFrame([*chain, *star, (30, 29), (7, 7)], "u long, v long")
    got = {r.u: r.root for r in components(links).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 5 for i in range(10, 31)}}


def test_rounds_of_components_with_few_edges_and_many(spark, monkeypatch):
    """Few edges are merged in one task, whatever the number of shuffle partitions; more are shuffled; both agree."""
    from textsentry.llm import components as stars

    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)]
    links = minhash.materialise(spark.createDataFrame([*edges, (900, 901), (901, 900)], "u long, v long").repartition(7), "links")
    plan = stars._round(links.where("u > v"), 260)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Broadcast" not in plan
    got = sorted(tuple(r) for r in stars.components(links).collect())
    monkeypatch.setattr(stars, "FEW_EDGES", 10)
    assert "hashpartitioning" in stars._round(links.where("u > v"), 260)._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in stars.components(links).collect()) == got
    root = {i: i for pair in edges for i in pair} | {900: 900, 901: 900}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == sorted((k, r) for k, r in root.items() if k != r)


def test_signatures_are_no_driver_table(spark, documents, monkeypatch):
    """Broadcasting them changes no link; more than a small table is joined by shuffle."""
    rng = random.Random(9)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(5)]
    docs = [" ".join([*t[:at], f"x{at}", *t[at + 1 :]]) for t in base for at in range(12)]
    found, plans = {}, []
    whole = minhash.materialise

    def seen(df, name):
        if name == "pairs":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return whole(df, name)

    monkeypatch.setattr(minhash, "materialise", seen)
    assert minhash.SIGNATURE_BYTES <= 4 << 20
    for limit in (minhash.SIGNATURE_BYTES, 0):
        monkeypatch.setattr(minhash, "SIGNATURE_BYTES", limit)
        plans.clear()
        got = minhash.near_duplicates(documents(list(enumerate(docs))), "doc_id", "text")
        found[limit] = sorted(tuple(r) for r in got.collect())
        assert all(("strategy=broadcast" in p) == (limit > 0) for p in plans) and len(plans) == 2
    assert len({str(v) for v in found.values()}) == 1
