import random
import time

import pytest
from pyspark.sql import functions as F

from textsentry import compile_rules, default_rules, register_scan, scan, select_rules
from textsentry.functions import regex
from textsentry.operators.rules import RuleError, rule_pack
from textsentry.operators.scan import prepare


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_one_sentence_two_rules(make_rules, texts):
    rules = make_rules(
        (
            "G",
            [
                {"name": "mail", "f_regex": r"[a-z.]+@[a-z.]+\.[a-z]{2,}", "loaded": True},
                {"name": "phone", "f_regex": r"1[3-9]\d{9}", "loaded": True, "engine": "go"},
            ],
        )
    )
    df = scan(texts("Mail jo.doe@example.org or call 13900001111 now"), rules, ["id"])
    assert found(df, "rule_name", "match", "position", "line_number", "sensitive") == [
        ("mail", "jo.doe@example.org", 5, 1, False),
        ("phone", "13900001111", 32, 1, False),
    ]
    assert df.columns[:1] == ["id"] and df.schema["position"].dataType.typeName() == "long"


def test_repeats_share_the_first_position(one_rule, texts):
    df = scan(texts("secret1 x\nsecret1 y"), one_rule("secret\\d"), ["id"])
    assert found(df, "match", "position", "line_number") == [("secret1", 0, 1)] * 2


def test_match_text_seen_earlier_without_matching_there(one_rule, texts):
    df = scan(texts("xabcdef\n abcdef"), one_rule(r"(?<= )abcdef"), ["id"])
    assert found(df, "position", "line_number") == [(1, 1)]


def test_short_matches_count_bytes_without_blanks(one_rule, texts):
    df = scan(texts("12345", "123456", "  12345   ", "日本"), one_rule(r"^.+$"), ["id"])
    assert found(df, "id", "match") == [(1, "123456"), (3, "日本")]


def test_byte_positions_and_lines(one_rule, texts):
    df = scan(texts("é日\n😀 token99"), one_rule(r"token\d+"), ["id"])
    assert found(df, "position", "line_number") == [(11, 2)]


def test_context_is_cut_by_bytes(one_rule, texts):
    rules = one_rule("secret", sensitive=True, context_left=3, context_right=2)
    df = scan(texts("ab日é secret日", "secret", "xysecretz"), rules, ["id"])
    assert found(df, "id", "context") == [(0, "é secret\ufffd"), (1, "secret"), (2, "xysecretz")]
    plain = scan(texts("ab secret cd"), one_rule("secret"), ["id"])
    assert found(plain, "context") == [("secret",)]
    wide = scan(texts("x" * 60 + "secret" + "y" * 60), one_rule("secret", sensitive=True), ["id"])
    assert found(wide, "context") == [("x" * 50 + "secret" + "y" * 50,)]


def test_case_lines_and_unicode_classes(one_rule, texts):
    assert found(scan(texts("SECRET"), one_rule("secret"), ["id"]), "match") == [("SECRET",)]
    lines = texts("a\r\nabcdef\r\n", "abcdef\nb")
    assert found(scan(lines, one_rule("abcdef$"), ["id"]), "id") == [(1,)]
    # A Chinese letter is a word character for one engine and not for the other.
    number = texts("号13900001111 ")
    assert found(scan(number, one_rule(r"[^\w]1\d{10}[^\w]"), ["id"]), "match") == []
    go = one_rule(r"[^\w]1\d{10}[^\w]", engine="go")
    assert found(scan(number, go, ["id"]), "match") == [("号13900001111 ",)]


def test_null_and_empty_texts_have_no_findings(one_rule, texts):
    assert scan(texts(None, ""), one_rule(".*secret"), ["id"]).count() == 0


def test_empty_pack_gives_empty_findings_with_schema(one_rule, texts):
    df = scan(texts("secret"), one_rule("secret", loaded=False), ["id"])
    assert df.count() == 0
    assert df.schema == scan(texts("secret"), one_rule("secret"), ["id"]).schema


def test_gate_respects_unicode_case_folding(one_rule, texts):
    pattern = "pass(?:word|key)\\d"
    compiled = compile_rules(select_rules(one_rule(pattern)), {pattern: ["word", "key"]})
    df = scan(
        texts("PASSWORD1", "paſſword1", "pa ss", "pASSword2", "pass\u212aEY3"), compiled, ["id"]
    )
    assert found(df, "id") == [(0,), (1,), (3,), (4,)]
    ungated = scan(texts("pass\u212aEY3"), one_rule(pattern), ["id"])
    assert ungated.count() == 1
    with pytest.raises(ValueError, match="ASCII"):
        compile_rules(one_rule(pattern), {pattern: ["é"]})


def test_join_plan_equals_unrolled_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pack = prepare(default_rules(spark, extended=True))
    unrolled = scan(docs, pack, ["doc_id"])
    joined = scan(docs, pack, ["doc_id"], plan="join")
    assert unrolled.count() > 0
    assert sorted(unrolled.collect()) == sorted(joined.collect())
    with pytest.raises(ValueError, match="plan"):
        scan(docs, pack, ["doc_id"], plan="other")


def test_any_number_of_rules_reads_the_texts_once(spark, make_rules):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extended = default_rules(spark, extended=True)
    many = [{"name": f"r{i}", "f_regex": f"secret{i:04d}", "loaded": True, "engine": "nfa"} for i in range(400)]
    filler = compile_rules(make_rules(("Filler", many)), gates={r["f_regex"]: [f"secret{r['name'][1:].zfill(4)[:2]}"] for r in many})
    pack = [*prepare(extended), *prepare(filler)]
    df = scan(docs, pack, ["doc_id"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReadSchema: struct<doc_id:bigint,text:string>") == 1
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert sorted(df.collect()) == sorted(scan(docs, extended, ["doc_id"]).collect())


def test_gates_and_odd_letters_in_the_join_plan(spark, make_rules, texts):
    rules = [
        {"name": "gated", "f_regex": r"secret\d+", "loaded": True, "engine": "nfa"},
        {"name": "free", "f_regex": r"number\d+", "loaded": True, "engine": "nfa"},
    ]
    pack = rule_pack(compile_rules(make_rules(("G", rules)), gates={r"secret\d+": ["secret", "ecre"]}))
    docs = texts("SECRET12 number34", "\u017fecret56", "nothing", "", None, "number78")
    joined = scan(docs, pack, ["id"], plan="join")
    assert found(joined, "id", "match") == [(0, "SECRET12"), (0, "number34"), (1, "\u017fecret56"), (5, "number78")]
    assert sorted(joined.collect()) == sorted(scan(docs, pack, ["id"]).collect())


@pytest.mark.parametrize("n", [150, 400])
def test_large_packs(make_rules, texts, n):
    rules = [{"name": f"r{i}", "f_regex": f"value{i:05d}", "loaded": True} for i in range(n)]
    df = scan(texts(f"value00000 and value{n - 1:05d}"), make_rules(("G", rules)), ["id"])
    assert found(df, "rule_name") == [("r0",), (f"r{n - 1}",)]


def test_unrolled_plan_runs_each_regex_once_and_does_not_shuffle(spark, texts):
    pack = prepare(default_rules(spark))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = scan(docs, pack, ["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("jdbc:[a-z:]+") == 1
    assert "Exchange" not in plan and "Join" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_nothing_is_scanned_twice_for_statistics(spark):
    from textsentry.operators import stats

    pack = prepare(default_rules(spark))
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = stats.overview(scan(docs, pack, ["doc_id"]), ["doc_id"])
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert shown.count("jdbc:[a-z:]+") == 1 and "Expand" not in shown


def test_other_spelling_of_a_foreign_pattern(one_rule, texts):
    pattern = r"(\()?[0-9]{3}(?(1)\)|-)[0-9]{4}"
    with pytest.raises(RuleError, match="does not compile"):
        prepare(one_rule(pattern))
    plain = {pattern: r"\([0-9]{3}\)[0-9]{4}|[0-9]{3}-[0-9]{4}"}
    pack = rule_pack(compile_rules(one_rule(pattern), forms=plain))
    df = scan(texts("call (555)0100 or 555-0101, not 5550102", None), pack, ["id"])
    assert found(df, "match", "position") == [("(555)0100", 5), ("555-0101", 18)]


def test_large_packs_are_unrolled_block_by_block(make_rules, texts):
    rules = [{"name": f"r{i}", "f_regex": f"secret{i:04d}", "loaded": True, "engine": "nfa"} for i in range(600)]
    pack = prepare(make_rules(("G", rules)))
    df = scan(texts("secret0001 secret0300", "secret0599"), pack, ["id"])
    assert found(df, "rule_name") == [("r1",), ("r300",), ("r599",)]
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString()


def test_match_primitives(spark):
    df = spark.createDataFrame([("a1b22c333",)], "t string")
    p = F.lit(r"(?dmiU)([a-z])(\d+)")
    row = df.select(
        regex.match_any(F.col("t"), p).alias("any"),
        regex.match_first(F.col("t"), r"(?dmiU)\d\d").alias("first"),
        regex.match_all(F.col("t"), p).alias("all"),
        regex.match_all(F.col("t"), p, 2).alias("two"),
        regex.match_groups(F.col("t"), p, 2).alias("groups"),
    ).first()
    assert row["any"] and row["first"] == "22"
    assert df.select(regex.match_first(F.col("t"), "(?dmiU)z")).first()[0] is None
    assert row["all"] == ["a1", "b22", "c333"] and row["two"] == ["a1", "b22"]
    assert tuple(row["groups"][1]) == ("b22", "b", "22")


DIALECT = [
    (r"\d{4}", "in 2024", True),
    (r"(?<y>\d{4})", "in 2024", True),
    (r"(?P<y>\d{4})", "in 2024", True),
    (r"foo(?=bar)", "foobar", True),
    (r"foo(?!bar)", "foobar", False),
    (r"(?<=foo)bar", "foobar", True),
    (r"(?<!foo)bar", "foobar", False),
    (r"(\w)\1", "hello", True),
    (r"(?<q>['\"])x\k'q'", "'x'", True),
    (r"(?P<q>['\"])x(?P=q)", "'x'", True),
    (r"[[:digit:]]+x", "12x", True),
]


def test_dialect(make_rules):
    rules = make_rules(
        ("G", [{"name": str(i), "f_regex": p, "loaded": True} for i, (p, _, _) in enumerate(DIALECT)])
    )
    compiled = {int(r["name"]): r["pattern"] for r in compile_rules(rules).collect()}
    spark = rules.sparkSession
    for i, (_, text, want) in enumerate(DIALECT):
        got = spark.range(1).select(F.rlike(F.lit(text), F.lit(compiled[i]))).first()[0]
        assert got is want, DIALECT[i]


def test_hostile_texts_finish(spark, texts):
    """Long chains, runs and prose that make careless patterns recurse or go quadratic."""
    words = random.Random(5).choices(["pass", "mot", "clé", "a", "long"], k=20_000)
    hostile = texts(
        "a_" * 40_000 + "@",
        "a" * 80_000 + "@",
        "x@" + "a-" * 40_000,
        " ".join(words) + " pwd",
        " C:" + "\\a" * 40_000,
        "'\"" * 30_000 + "password",
    )
    start = time.time()
    scan(hostile, default_rules(spark), ["id"]).count()
    assert time.time() - start < 120


@pytest.mark.parametrize("pattern", [r"(?:[a-z]+[-.])+[a-z]+!", r"(?:a|b){1,100000}c", r"(a|b)*?c", r"(?:ab){70}",
    r"(?:(?:a|b){64}){64}c", r"(?:(?:a|b){9}){9}", r"(a|b){40}x(a|b){40}", r"((a)*)*+", r"(?>(a|b)*)c", r"(a|b){2,}"])
def test_group_loops_are_refused_by_name(one_rule, pattern):
    with pytest.raises(RuleError, match=r"possessive.*\[G:R\]"):
        prepare(one_rule(pattern))


@pytest.mark.parametrize(
    "pattern",
    [r"(?:[a-z]{1,9}[-.]){1,9}!", r"(?:[a-z]++[-.])*+[a-z]+!", r"foo\)+bar", r"[()*]+xyz", r"[])+]+x", r"\[(a)\]{2}",
     r"\Q)+(\E{3}", r"\Q)*", r"(?:(?:a|b){7}){8}c", r"(a|b){30}x(a|b){30}", r"(?:(?:a|b){60})*+c", r"((a))?(b)"],
)
def test_harmless_repeats_are_not(one_rule, pattern):
    assert prepare(one_rule(pattern))[0]["compile_ok"]


def test_the_most_rounds_allowed_fit_the_stack(one_rule, texts):
    """Nested and following repeats up to the bound, each tried at every place of a long text."""
    body = "ab" * 5_000
    for pattern in (r"(?:(?:a|b){7}){8}c", r"(a|b){1,30}(a|b){30}c", r"(?:(?:(?:a|b){3}){3}){4}c"):
        assert scan(texts(body, body + "c"), one_rule(pattern), ["id"]).select("id").distinct().count() == 1


def test_possessive_loops_run_on_long_texts(one_rule, texts):
    df = scan(texts("aa-bb.cc!", "a-" * 60_000 + "a!", "x" * 9), one_rule(r"(?:[a-z]++[-.])++[a-z]+!"), ["id"])
    assert [(r["id"], len(r["match"])) for r in df.orderBy("id").collect()] == [(0, 9), (1, 120_002)]


@pytest.mark.parametrize(
    "name, text, match",
    [
        ("Web Address", "see https://a.example/" + "x" * 2000 + " end", "https://a.example/" + "x" * 2000),
        ("Long Digit Run", "card " + "4" * 40 + " end", "4" * 40),
        ("Hex Secret", "id " + "0a" * 32 + " end", "0a" * 32),
        ("Quoted Path", "href='/" + "p/" * 350 + "' end", "'/" + "p/" * 350 + "'"),
        ("Licence Line", "licensed under " + "terms " * 90, "licensed under " + "terms " * 90),
        ("User Field", 'created_by = "' + "n" * 90 + '"', 'created_by = "' + "n" * 90 + '"'),
        ("Route Change", "x.router.push('/team/7')", "router.push('/team/7"),
        ("Request Line", "GET /a?b=c HTTP/1.1", "GET /a?b=c HTTP/1.1"),
        ("Company Key Value", "corpid: 'ab12cd34'", "corpid: 'ab12cd34"),
        ("Secret Field", 'client_secret="v9x2-q7"', 'secret="v9x2-q7"'),
    ],
)
def test_extended_detectors_take_whole_matches(spark, texts, name, text, match):
    df = scan(texts(text), default_rules(spark, extended=True), ["id"])
    assert (name, match) in found(df, "rule_name", "match")


def test_a_pack_as_a_sql_function(spark, texts, make_rules):
    """The same findings as the scan's, quotes and backslashes in rules and texts included."""
    rules = make_rules(
        ("It's", [
            {"name": "Q'uote", "f_regex": r"'[^'\\]{6,9}'", "loaded": True, "engine": "nfa", "sensitive": True, "context_left": 3, "context_right": 2},
            {"name": "Word", "f_regex": r"secret\d\d", "loaded": True, "engine": "go", "sensitive": False},
        ])
    )
    pack = prepare(rules)
    df = texts("é'abc def'\nsecret11 SECRET22 secret11", None, "", "日'secret33'", "short 'ab'")
    register_scan(spark, pack, "find_them")
    df.createOrReplaceTempView("sql_texts")
    got = spark.sql("SELECT id, inline(found) FROM (SELECT id, find_them(text) AS found FROM sql_texts)").collect()
    want = scan(df, pack, ["id"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) >= 5
    with pytest.raises(RuleError, match="1 to"):
        register_scan(spark, [])


def test_spread_goes_by_splits(spark, tmp_path):
    from textsentry.session import spread

    cores = spark.sparkContext.defaultParallelism
    for parts, moved in ((1, True), (cores, False)):
        path = f"{tmp_path}/{parts}"
        spark.range(100 * cores).repartition(parts).write.parquet(path)
        before = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
        spark.conf.set("spark.sql.files.openCostInBytes", "64k")
        plan = spread(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
        for k, v in before.items():
            spark.conf.set(k, v)
        assert ("Exchange" in plan) == moved


def test_secrets_file(spark, texts):
    """One line per detector of the default pack, all values invented."""
    body = "\n".join(
        [
            "cloud access_key_id",
            'password="not-a-real-one"',
            'api_key="zz_test_0123456789abcdef"',
            "someone@example.org",
            "tel 13900001111 .",
            "id 330106198807153219 .",
            "jdbc:postgresql://db.example.net:5432/sales",
            "bearer q1w2e3r4t5y6",
            "at 192.168.44.7 now",
            "mac 0a:1b:2c:3d:4e:5f",
            "dir C:\\Temp\\notes",
        ]
    )
    rows = found(scan(texts(body), default_rules(spark), ["id"]), "rule_name")
    assert {name for (name,) in rows} == {
        r["name"] for r in default_rules(spark).select("name").collect()
    }
