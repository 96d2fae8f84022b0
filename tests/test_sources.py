import random
import re
import sys
import time

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textsentry import scan, scan_rows, scan_tree
from textsentry.functions.text import running_totals
from textsentry.operators.scan import prepare, scan_large
from textsentry.sources import chunks, files


scanning = sys.modules["textsentry.operators.scan"]


def test_tree_filters_and_guards(spark, tmp_path, one_rule):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"first\nsecret01")
    (tmp_path / "sub" / "b.TXT").write_bytes("日本 secret02".encode())
    (tmp_path / "sub" / "c.js").write_bytes(b"secret03")
    (tmp_path / "skip.me.md").write_bytes(b"secret04")
    (tmp_path / "big.txt").write_bytes(b"secret05" + b" " * (2 << 20))
    (tmp_path / "empty.txt").write_bytes(b"")
    rules = one_rule(r"secret\d\d")

    def matches(**options):
        found, errors = scan_tree(spark, str(tmp_path), rules, **options)
        return sorted(r["match"] for r in found.collect()), errors.collect()

    every, errors = matches()
    assert every == [f"secret0{i}" for i in range(1, 6)]
    def named(rows):
        return sorted((r["path"].rsplit("/", 1)[1], r["error"]) for r in rows)

    # Spark's file source leaves empty files out; the listing has them.
    assert named(errors) == [("empty.txt", "is empty")]
    assert errors[0]["path"] == f"file:{tmp_path}/empty.txt"
    assert matches(exclude_ext=["txt"])[1] == []
    assert matches(exclude_ext=["txt", ".MD"])[0] == ["secret03"]
    assert matches(exclude_path=["sub", "skip"])[0] == ["secret01", "secret05"]
    kept, errors = matches(limit_mb=1)
    assert kept == [f"secret0{i}" for i in range(1, 5)]
    assert named(errors) == [("big.txt", "is above the size limit"), ("empty.txt", "is empty")]
    assert matches(limit_mb=0)[0] == every
    found, _ = scan_tree(spark, str(tmp_path / "sub"), rules, exclude_ext=["js"])
    row = found.first()
    assert (row["position"], row["line_number"]) == (7, 1)
    with pytest.raises(ValueError, match="no files"):
        scan_tree(spark, str(tmp_path), rules, exclude_path=["/"])


def test_listing_walks_every_folder_once(spark, tmp_path, monkeypatch):
    from textsentry.sources import listing

    want = []
    for i in range(40):
        folder = tmp_path / f"d{i % 7}" / f"e{i % 3}" / f"f={i}"
        folder.mkdir(parents=True)
        (folder / f"x{i}").write_bytes(b"x" * (i % 4))
        want.append((f"file:{folder}/x{i}", i % 4, None))
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "x").write_bytes(b"x")
    (tmp_path / "_log").write_bytes(b"x")
    got = sorted(tuple(r) for r in listing.list_files(spark, str(tmp_path)).collect())
    assert got == sorted(want)
    # The driver opens folders until there are enough; the rest is walked by tasks.
    parts = [p.value for p in listing._Reader([f"file:{tmp_path}"]).partitions()]
    assert len(parts) >= listing.FOLDERS and {deep for _, deep in parts} == {True, False}
    assert sorted(tuple(r) for r in listing.list_files(spark, f"{tmp_path}/d[01]").collect()) == sorted(
        w for w in want if "/d0/" in w[0] or "/d1/" in w[0]
    )
    gone = list(listing._Reader([f"file:{tmp_path}/gone"]).read(listing.InputPartition((f"file:{tmp_path}/gone", True))))
    assert gone == [(f"file:{tmp_path}/gone", None, "cannot be listed")]


def test_size_limit_reaches_the_listing(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    plan = files.read_files(spark, str(tmp_path), limit_mb=5)._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,5242880)" in plan


def test_charsets(spark):
    rows = spark.createDataFrame(
        [
            ("utf8", "é密码 secret1".encode()),
            ("gbk", "密码 secret2".encode("gbk")),
            ("latin", "é secret3".encode("latin-1")),
            ("bad", b"\xff\xff\xff"),
            ("empty", b""),
            ("mark8", b"\xef\xbb\xbf" + "é secret4".encode()),
            ("mark16le", b"\xff\xfe" + "é secret5".encode("utf-16-le")),
            ("mark16be", b"\xfe\xff" + "é secret6".encode("utf-16-be")),
        ],
        "path string, content binary",
    )
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    decoded = files.decode_text(rows, charsets=("GB18030", "ISO-8859-1"))
    got = {r["path"]: (r["charset"], r["text"]) for r in decoded.collect()}
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before
    assert got["utf8"] == ("UTF-8", "é密码 secret1")
    assert got["gbk"] == ("GB18030", "密码 secret2")
    assert got["latin"] == ("ISO-8859-1", "é secret3")
    strict = files.decode_text(rows, charsets=("GB18030",))
    errors = {r["path"]: r["error"] for r in files.scan_errors(strict, ["path"]).collect()}
    assert errors == {"bad": "cannot be decoded", "empty": "is empty", "latin": errors.get("latin")}
    assert files.scannable(strict).where("path IN ('bad', 'empty')").isEmpty()


def _pieces(df, **options):
    rows = chunks.chunk_texts(df, ["id"], **options).orderBy("id", "chunk_idx").collect()
    out = {}
    for r in rows:
        out.setdefault(r["id"], []).append(r)
    return out


def test_small_texts_stay_whole(texts):
    got = _pieces(texts("abc", "", "é" * 700_000, None))
    assert {i: [(c["chunk_idx"], c["start_offset"], c["start_line"]) for c in cs] for i, cs in got.items()} == {
        0: [(0, 0, 1)],
        1: [(0, 0, 1)],
        2: [(0, 0, 1)],
    }
    assert got[2][0]["text"] == "é" * 700_000


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.lists(st.text(alphabet="aé日😀\n", min_size=30, max_size=200), min_size=20, max_size=20),
    st.integers(4, 40),
)
def test_chunks_rebuild_the_text(texts, values, size):
    got = _pieces(texts(*values), threshold_mb=20 / 1024 / 1024, chunk_bytes=size, overlap=0)
    for i, value in enumerate(values):
        raw = value.encode()
        assert "".join(c["text"] for c in got[i]) == value
        for c in got[i]:
            head = raw[: c["start_offset"]].decode()
            assert c["start_line"] == 1 + head.count("\n")
            assert len(c["text"].encode()) <= size + 3


def test_chunk_edges_lose_and_double_nothing(texts, one_rule):
    body = "x" * 95 + "secret77" + "\n" * 50 + "secret88 secret88" + "é" * 30 + "1" * 35 + "y" * 60
    pack = prepare(one_rule(r"secret\d\d|1{13,}", sensitive=True, context_left=3, context_right=2))

    def run(size):
        sizes = {"threshold_mb": 0.00001, "chunk_bytes": size, "overlap": 40}
        pieces = chunks.chunk_texts(texts(body), ["id"], **sizes, spread_chunks=True)
        own = {"offset_col": "start_offset", "line_col": "start_line", "own_cols": ("own_from", "own_to")}
        rows = scan(pieces, pack, ["id"], **own).collect()
        return sorted((r["position"], r["match"], r["line_number"], r["context"]) for r in rows)

    whole = run(10_000)
    assert [w[:3] for w in whole] == [(95, "secret77", 1), (153, "secret88", 51), (162, "secret88", 51), (230, "1" * 35, 51)]
    assert whole[0][3] == "xxxsecret77\n\n"
    for size in (17, 50, 100, 101, 160):
        assert run(size) == whole


@pytest.mark.parametrize("size", [64, 1000, 2048])
def test_matches_side_by_side_go_on_through_all_chunks(texts, one_rule, size):
    """What matches depends on where the match before it ended, back to the text's start."""
    body = "b" * 13 + "a" * 3000 + "c" + "a" * 2000
    rows = texts(body, "a" * 30, None, body[5:])
    sizes = {"threshold_mb": 0.0001, "chunk_bytes": size, "overlap": 32}
    got = scan_large(rows, one_rule("a{7}"), ["id"], **sizes).collect()
    for i, text in enumerate([body, "a" * 30, "", body[5:]]):
        want = [m.start() for m in re.finditer("a{7}", text)]
        assert sorted(r["position"] for r in got if r["id"] == i) == want


def test_only_rules_that_run_over_a_cut_are_matched_again(texts, make_rules, monkeypatch):
    seen = []
    exact = scanning._exact
    monkeypatch.setattr(scanning, "_exact", lambda df, *rest: seen.append(df) or exact(df, *rest))
    rules = [{"name": n, "f_regex": p, "loaded": True, "engine": "nfa"} for n, p in (("Tile", "[ab]{9}"), ("Lone", r"secret\d\d"))]
    rows = texts("ab" * 200 + " secret11 " + "ab" * 200, "x" * 300 + " secret22 " + "x" * 300)
    got = scan_large(rows, prepare(make_rules(("G", rules))), ["id"], threshold_mb=0.0001, chunk_bytes=100, overlap=20).collect()
    assert sorted((r["id"], r["position"]) for r in got if r["rule_name"] == "Lone") == [(0, 401), (1, 301)]
    assert len([r for r in got if r["rule_name"] == "Tile"]) == 88
    assert [(r["id"], r["__only"]) for r in seen[1].collect()] == [(0, [0])]


def test_pieces_keep_only_matches_that_are_used(texts, make_rules, monkeypatch):
    """Of a rule that is matched again, and of what lies in the overlap alone, nothing is written."""
    written = {}
    write = scanning.materialise
    monkeypatch.setattr(scanning, "materialise", lambda df, name: written.setdefault(name, write(df, name)))
    rules = [{"name": n, "f_regex": p, "loaded": True, "engine": "nfa"} for n, p in (("Tile", "[ab]{9}"), ("Lone", r"secret\d\d"))]
    rows = texts("ab" * 200 + " secret11 " + "ab" * 200, " ".join(f"secret{i}" for i in range(10, 90)))
    got = scan_large(rows, prepare(make_rules(("G", rules))), ["id"], threshold_mb=0.0001, chunk_bytes=100, overlap=50).collect()
    assert len([r for r in got if r["rule_name"] == "Tile"]) == 88 and len(got) == 88 + 81
    held = written["chunks"].where("NOT __over").select(F.explode("__found.start").alias("at"), "own_from", "own_to").collect()
    assert held and all(h["own_from"] <= h["at"] < h["own_to"] for h in held)
    assert not written["chunks"].where("__over").isEmpty()
    assert written["chunks"].where("__over AND size(__found) > 0").isEmpty()


def test_matches_of_one_text_take_linear_time(texts, one_rule):
    page = "\n".join(f'<a href="/path/{i:07d}/index">text {i}</a>' for i in range(20_000))
    start = time.time()
    rows = scan_large(texts(page), one_rule(r'"/[^"]{1,99}"'), ["id"], threshold_mb=100)
    found = rows.agg(F.count("*"), F.max("position"), F.max("line_number")).first()
    assert (found[0], found[2]) == (20_000, 20_000) and page.encode()[found[1] :].startswith(b'"/path/0019999')
    assert time.time() - start < 40


def test_running_totals(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randint(0, 9) for _ in range(n)]) for i, n in enumerate([0, 1, 2, 127, 128, 129, 256, 1000])]
    df = spark.createDataFrame(rows, "i int, xs array<long>").withColumn("t", running_totals(F.col("xs")))
    for r in df.collect():
        assert r.t == [sum(r.xs[:k]) for k in range(len(r.xs))]


def test_set_off_marks_in_texts_are_harmless(texts, one_rule):
    own = {"own_cols": ("a", "z")}
    docs = texts("x\ufdd0secret11\ufdd0 secret22").withColumns({"a": F.lit(0), "z": F.lit(100)})
    rows = scan(docs, one_rule(r"secret\d\d"), ["id"], **own).collect()
    assert sorted((r["match"], r["position"]) for r in rows) == [("secret11", 4), ("secret22", 16)]


def test_large_file_rows_are_chunked(spark, one_rule):
    body = ("line\n" * 1000 + "secret42\n") * 3
    rows = spark.createDataFrame([("p", bytearray(body.encode()))], "path string, content binary")
    found, errors = scan_rows(
        rows, one_rule(r"secret\d\d"), chunk_threshold_mb=0.001, chunk_bytes=5009
    )
    got = sorted((r["position"], r["line_number"]) for r in found.collect())
    assert got == [(5000 + 5009 * i, 1001 * (i + 1)) for i in range(3)]
    assert errors.count() == 0


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab1é日\n ", max_size=120), min_size=30, max_size=30))
def test_position_points_at_the_match(texts, one_rule, values):
    df = scan(texts(*values), one_rule(r"[ab1é]{3,9}", sensitive=True, context_left=4), ["id"])
    for r in df.collect():
        raw, hit = values[r["id"]].encode(), r["match"].encode()
        assert raw[r["position"] :].startswith(hit)
        assert r["position"] == raw.find(hit)
        assert r["line_number"] == 1 + raw[: r["position"]].count(b"\n")
        start = max(0, r["position"] - 4)
        want = raw[start : r["position"] + len(hit)].decode("utf-8", "replace")
        assert r["context"] == want


def test_sizes_of_table_texts(texts):
    small = files.limit_size(texts("é" * 10, "é" * 11), 20 / 1024 / 1024, F.octet_length("text"))
    assert [r["id"] for r in small.collect()] == [0]


def test_charsets_without_a_mark(spark):
    russian, chinese = "привет мир secret1\n", "密码在这里\n第二行"
    cases = {
        "le": ("é secret4 für".encode("utf-16-le"), "UTF-16LE"),
        "be": ("é secret5 für".encode("utf-16-be"), "UTF-16BE"),
        "russian le": (russian.encode("utf-16-le"), "UTF-16LE"),
        "russian be": (russian.encode("utf-16-be"), "UTF-16BE"),
        "chinese le": (chinese.encode("utf-16-le"), "UTF-16LE"),
        "chinese be": (chinese.encode("utf-16-be"), "UTF-16BE"),
        "emoji": ("a😀b 😀".encode("utf-16-le"), "UTF-16LE"),
        "stray zero": (b"hello world\x00", "UTF-8"),
        "odd length": (b"hello wo\x00rld\x00\x00", "UTF-8"),
        "zeros": (b"\x00" * 6, "UTF-8"),
        "latin": ("élève à l'école, été, garçon".encode("latin-1"), "ISO-8859-1"),
        "gbk": ("密码在这里 secret".encode("gbk"), "GB18030"),
        "utf8": ("élève 密码".encode(), "UTF-8"),
        "empty": (b"", "UTF-8"),
    }
    names = {"UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "UTF-8": "utf-8", "ISO-8859-1": "latin-1", "GB18030": "gb18030"}
    rows = spark.createDataFrame([(k, v[0]) for k, v in cases.items()] + [("null", None)], "path string, content binary")
    got = {r["path"]: r for r in files.decode_text(rows, charsets=("GB18030", "ISO-8859-1")).collect()}
    for name, (raw, charset) in cases.items():
        assert (name, got[name]["charset"], got[name]["text"]) == (name, charset, raw.decode(names[charset]))
    assert got["null"]["text"] is None
