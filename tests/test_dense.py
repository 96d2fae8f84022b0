import random
import time

from pyspark.sql import functions as F

from textsentry import scan
from textsentry.functions import dense
from textsentry.operators.scan import prepare


def test_dense_texts_are_located_like_sparse_ones(texts, one_rule):
    """Repeats, earlier occurrences outside a match, wide characters and both text ends."""
    rng = random.Random(3)
    words = ["é", "日本", "<k0012", "k0012>", "\n", "😀", "x", " "]
    body = "".join(
        rng.choice(words) + (f"<k{rng.randint(0, 99):04d}>" if rng.random() < 0.5 else "")
        for _ in range(12_000)
    )
    pack = prepare(one_rule(r"(?<=<)k\d{4}>", sensitive=True, context_left=5, context_right=3))
    few = body[:200]
    df = texts(body, few)
    flags = df.select(
        "id", dense.is_dense(F.col("text"), F.regexp_extract_all("text", F.lit(r"(?<=<)k\d{4}>"), F.lit(0)))
    ).collect()
    assert [bool(r[1]) for r in sorted(flags)] == [True, False]
    rows = scan(df, pack, ["id"]).collect()
    assert {r["id"] for r in rows} == {0, 1}
    for r in rows:
        raw, hit = (body, few)[r["id"]].encode(), r["match"].encode()
        at = raw.find(hit)
        around = raw[max(0, at - 5) : at + len(hit) + 3].decode("utf-8", "replace")
        assert (r["position"], r["line_number"], r["context"]) == (
            at,
            1 + raw[:at].count(b"\n"),
            around,
        )


def test_link_heavy_page_is_not_quadratic(texts, one_rule):
    page = "\n".join(f'<a href="/path/{i:07d}/index">text {i}</a>' for i in range(15_000))
    pack = prepare(one_rule(r'"/[^"]{1,99}"'))
    start = time.time()
    assert scan(texts(page), pack, ["id"]).count() == 15_000
    found = scan(texts(page), pack, ["id"]).agg(F.max("position"), F.max("line_number")).first()
    assert found[1] == 15_000 and found[0] > 500_000
    assert time.time() - start < 60
