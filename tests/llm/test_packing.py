"""Packing: ids as the library gives them, every id in one piece, and neighbours by plain BM25."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from textsentry.llm import packing, queries


@pytest.fixture(scope="module")
def path():
    return queries.packing_tokenizer()


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_the_library(path):
    rng = random.Random(2)
    atoms = ["a", "the", " ", "  ", "\n", "\t", "é", "漢字", "　", "\x85", "\x1c", "<|endoftext|>", "'s", "12", "!?", "​", "ing", "\r\n", "🙂"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    few = ["a", "The", " b", "\n", "'s", "'ll", "é", "Ǝ", "½", "²", "12", "!?", "#", "ªº", "\x00", "\x7f", "­"]
    texts += ["".join(rng.choice(few) for _ in range(rng.randint(0, 12))) for _ in range(8000)]
    texts += [" ".join(rng.choice(atoms) for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "x" * 3000, " ".join(["word"] * 3000), "lead ing \n", "\n a", "a \n b"]
    encoder, want = packing.Encoder(path), library(path)
    assert encoder.plain
    for some in (texts, texts[:1], texts[-3:], []):
        ids, bounds = encoder.ids(pa.array(some, pa.string()))
        assert len(bounds) == len(some) + 1
        for text, a, b in zip(some, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == want(text), repr(text)


def test_words_are_forgotten_and_learned_again(path, monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    rng = random.Random(6)
    encoder, want = packing.Encoder(path), library(path)
    for _ in range(20):
        texts = [" ".join(f"w{rng.randint(0, 60)}" + rng.choice(["", "x" * 90]) for _ in range(9)) for _ in range(4)]
        ids, bounds = encoder.ids(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [want(t) for t in texts]
    assert max(map(len, encoder.pieces)) <= packing.LONGEST and len(encoder.pieces) < 50


def test_other_tokenizers_get_whole_texts():
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    encoder, want = packing.Encoder(path), library(path)
    assert not encoder.plain
    texts = ["a b  c", "", " x "]
    ids, bounds = encoder.ids(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [want(t) for t in texts]


def check_pieces(pieces, rows, path, window=packing.WINDOW):
    """Pieces (with ids) cover every document once, in gapless sequences of full or power-of-two length."""
    want = library(path)
    docs = Counter((key, tuple(want(text) + [1])) for key, text in rows)
    made = defaultdict(list)
    for p in pieces:
        assert p.length == len(p.ids) // 4 > 0
        made[p.doc_id, p.doc_tokens].append((p.start, list(np.frombuffer(p.ids, "<u4"))))
    for key, n in {(k, len(ids)) for k, ids in docs}:
        same = {ids: c for (k, ids), c in docs.items() if k == key and len(ids) == n}
        heap = sorted(made.pop((key, n)))
        assert sum(len(x) for _, x in heap) == n * sum(same.values())
        at = Counter()
        for start, ids in heap:
            at.update({(start + i, t): 1 for i, t in enumerate(ids)})
        assert at == Counter({(i, t): sum(c for ids, c in same.items() if ids[i] == t) for ids in same for i, t in enumerate(ids)})
    assert not made
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == window or (at < window and at & (at - 1) == 0)


def some_texts(rng, n):
    topics = [[f"{chr(97 + t)}{w}" for w in range(200)] for t in range(5)]
    return [" ".join(rng.choice(topics[i % 5]) for _ in range(rng.choice([3, 40, 300, 1500]))) for i in range(n)]


def test_every_id_is_in_one_piece(documents, awkward, path):
    rng = random.Random(8)
    rows = list(enumerate(some_texts(rng, 60))) + [(100, None), (101, ""), (None, "no id"), (None, "no id"), (7, "another text of id 7")]
    pieces = packing.pack(documents(rows), "doc_id", "text", path, shard_tokens=1 << 14).collect()
    check_pieces(pieces, rows, path)
    assert {p.role for p in pieces} >= {"window", "seed", "neighbour", "rest"}
    check_pieces(packing.pack(awkward, "doc_id", "text", path).collect(), [(r.doc_id, r.text) for r in awkward.collect()], path)
    assert packing.pack(documents([]), "doc_id", "text", path).collect() == []


def test_lengths_at_the_window(documents, path):
    rows = [(n, " ".join(["a"] * n)) for n in (2046, 2047, 2048, 4094, 4095, 4096)]
    pieces = packing.pack(documents(rows), "doc_id", "text", path).collect()
    check_pieces(pieces, rows, path)
    assert Counter(p.role for p in pieces)["window"] == 7


def brute_scores(tails, seed):
    """BM25 of every tail for the seed's rarest shared terms, term by term."""
    n, mean = len(tails), sum(map(len, tails)) / len(tails)
    df = Counter(t for x in tails for t in set(x.tolist()))
    idf = {t: math.log1p((n - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    terms = sorted((t for t in set(tails[seed].tolist()) if df[t] > 1), key=lambda t: (-idf[t], t))[: packing.QUERY_TERMS]
    out = []
    for x in tails:
        tf, norm = Counter(x.tolist()), packing.K1 * (1 - packing.B + packing.B * len(x) / mean)
        out.append(sum(idf[t] * tf[t] * (packing.K1 + 1) / (tf[t] + norm) for t in terms if tf[t]))
    return out


def test_scores_equal_plain_bm25():
    rng = np.random.default_rng(1)
    tails = [rng.integers(0, 90, rng.integers(1, 80)).astype("<u4") for _ in range(60)]
    index = packing.Index(tails)
    for seed in range(60):
        assert np.allclose(index.scores(tails[seed]), brute_scores(tails, seed), rtol=1e-5)


def test_windows_take_the_best_unused_neighbours(monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 2)
    rng = np.random.default_rng(5)
    tails = [(rng.integers(0, 40, rng.integers(5, 30)) + 100 * (i % 4)).astype("<u4") for i in range(80)]
    windows = list(packing.fill_windows(tails, 64))
    used, seen = set(), [np.zeros(len(t), int) for t in tails]
    for pieces in windows:
        assert sum(b - a for _, a, b, _ in pieces) == 64 or pieces is windows[-1]
        left = []
        for one, a, b, role in pieces:
            seen[one][a:b] += 1
            if role in ("seed", "rest"):
                used.add(one)
                score = brute_scores(tails, one)
                left = sorted((x for x in range(80) if x not in used and score[x] > 0), key=lambda x: (-round(score[x], 4), x))
            else:
                assert score[one] == pytest.approx(score[left[0]], rel=1e-4)
                left.remove(one)
                used.add(one)
    assert all((s == 1).all() for s in seen)
    topics = [{int(tails[p[0]][0]) // 100 for p in pieces} for pieces in windows]
    assert sum(len(t) == 1 for t in topics) > len(windows) * 0.8


def test_one_hot_group_of_copies_and_many_tiny_texts(documents, path):
    rows = [(i, "the same passage again and again" if i % 3 else "") for i in range(3000)]
    pieces = packing.pack(documents(rows), "doc_id", "text", path, shard_tokens=1 << 14).collect()
    check_pieces(pieces, rows, path)


def test_the_query(spark, tmp_path, documents, path):
    rows = list(enumerate(some_texts(random.Random(4), 30)))
    documents(rows).write.parquet(f"{tmp_path}/documents.parquet")
    ids = library(path)
    got = queries.op11_pack(spark, str(tmp_path)).collect()
    for r in got:
        whole = [*ids(rows[r.doc_id][1]), 1]
        part = np.array(whole[r.start : r.start + r.length], "<u4")
        assert (r.doc_tokens, r.ids_crc32) == (len(whole), zlib.crc32(part.tobytes()))
    assert sum(r.length for r in got) == sum(len(ids(t)) + 1 for _, t in rows)
