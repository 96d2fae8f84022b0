"""The cheaper spellings find what the patterns they stand for find."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textsentry.functions.regex import JAVA_FLAGS
from textsentry.functions.text import contains_any
from textsentry.plans.oracle import _unicode
from textsentry.sources import packs
from textsentry.sources.equivalents import FILTERS, GATES, SAFE_FORMS

PIECES = {
    "EMAIL": "a,b1,cd,efghijk,@,@a,x@b.,.,.,_,-,|, ,\n,com,.cn,X,community,É",
    "PASSWORD": "pass,password,pwd,passwd,=,==,!=,:,',\",\\, ,a,bc,).val(,.,),\n,user,!,(,0123456789",
    "WINDOWS_PATH": "C:,\\,\\,a,b.c,/,<,|, ,\n,d:,:,x,.",
    "ID_CARD": "11010119,900101,1234,19900101,X, ,\n,1101011990010112,199,12,31,0,123456,a",
    "MOBILE": "+86,86,0086,13912345678,1391,2345678,4567,199, ,a,\n,é,x,8,1",
}


def spelled(pieces):
    return [p for p in pieces.split(",")] + [","]


@pytest.mark.parametrize("name", PIECES)
def test_same_matches(spark, name):
    pattern = getattr(packs, name)
    rng = random.Random(name)
    pieces = spelled(PIECES[name])
    texts = pd.DataFrame(
        {
            "i": range(20_000),
            "t": ["".join(rng.choices(pieces, k=rng.randint(1, 30))) for _ in range(20_000)],
        }
    )
    safe = JAVA_FLAGS + SAFE_FORMS.get(pattern, pattern)
    gate = contains_any(F.lower("t"), GATES.get(pattern, [""]))
    kept = F.rlike("t", F.lit(JAVA_FLAGS + FILTERS.get(pattern, "")))
    rows = (
        spark.createDataFrame(texts)
        .select("i", F.regexp_extract_all("t", F.lit(safe), F.lit(0)).alias("m"), (gate & kept).alias("open"))
        .collect()
    )
    got = {r["i"]: r["m"] for r in rows}
    opened = {r["i"]: r["open"] for r in rows}
    con = duckdb.connect()
    con.register("texts", texts)
    lookahead = "(?!" in pattern
    if lookahead:
        import regex

        plain = regex.compile(pattern, regex.MULTILINE | regex.IGNORECASE)
        want = {i: [m.group() for m in plain.finditer(t)] for i, t in texts.itertuples(index=False)}
    else:
        want = dict(
            con.execute(
                "SELECT i, regexp_extract_all(t, ?) FROM texts", ["(?mi)" + _unicode(pattern)]
            ).fetchall()
        )
    wrong = [(texts["t"][i], m, got[i]) for i, m in want.items() if m != got[i]]
    assert not wrong, wrong[:3]
    closed = [texts["t"][i] for i, m in want.items() if m and not opened[i]]
    assert not closed, closed[:3]
    assert sum(map(len, want.values())) > 50
