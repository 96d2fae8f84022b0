import pytest

from textsentry import Output, process_results, rule_report
from textsentry.operators import findings as post
from textsentry.operators import sinks, stats
from textsentry.schemas import FINDING_FIELDS

SCHEMA = "path string, " + FINDING_FIELDS.simpleString()[len("struct<") : -1].replace(
    "group:", "`group`:"
).replace(":", " ")


@pytest.fixture(scope="module")
def findings(spark):
    rows = [
        ("/a", "G1", "one", "'(quoted \\/ value)'\n", " [ctx] ", 1, 1, True),
        ("/a", "G1", "two", "plain Test", "c,\"d\"\ne", 2, 1, False),
        ("/b", "G2", "one", "  blanks\t", "", 3, 2, True),
        ("/b", "G2", "three", "x{y}z", "日本", 4, 9, False),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def values(df, column):
    return sorted(r[column] for r in df.collect())


def test_clean_up(findings):
    got = post.clean(findings, ["path"])
    assert values(got, "match") == ["blanks", "plain Test", "quoted / value", "x{y}z"]
    assert "ctx" in values(got, "context")
    assert got.columns == findings.columns


def test_blocklist_is_case_sensitive(findings):
    assert post.block(findings, ["test"]).count() == 4
    assert post.block(findings, ["Test", "y}"]).count() == 2
    assert post.block(findings, []).count() == 4
    counts = post.block_counts(findings, ["Test"]).first()
    assert (counts["before"], counts["after"]) == (4, 3)
    # The word sits only in what the clean-up strips.
    assert post.block(post.clean(findings), ["'("]).count() == 4
    assert post.block(findings, ["'("]).count() == 3


def test_output_keys(findings):
    got = post.select_keys(findings, ["match", "file", "position"], ["path"])
    assert got.columns == ["match", "path", "position"]
    assert post.select_keys(findings, [], ["path"]).columns == findings.columns
    with pytest.raises(ValueError, match="colour"):
        post.select_keys(findings, ["match", "colour"], ["path"])


def test_grouping(findings):
    def buckets(field):
        rows = post.group_findings(findings, field, ["path"]).collect()
        out = {}
        for r in rows:
            out[r["bucket"]] = out.get(r["bucket"], 0) + r["n"]
        return out

    assert buckets("group") == {"G1": 2, "G2": 2}
    assert buckets("rule_name") == {"one": 2, "two": 1, "three": 1}
    assert buckets("file") == {"/a": 2, "/b": 2}
    assert buckets("match") == {"": 4}


def test_statistics(spark, findings):
    row = stats.overview(findings, ["path"]).first()
    assert row.asDict() == {"total": 4, "sensitive": 2, "files": 2, "groups": 2}
    assert {r["group"]: r["n"] for r in stats.by_group(findings).collect()} == {"G1": 2, "G2": 2}
    assert [tuple(r) for r in stats.sorted_rules(findings).collect()] == [
        ("one", 2),
        ("three", 1),
        ("two", 1),
    ]
    many = spark.createDataFrame(
        [("/a", "G", name, "m", "c", 0, 1, False) for name in "ffggabcde"], SCHEMA
    )
    assert [r["rule_name"] for r in stats.top_rules(many).collect()] == ["f", "g", "a", "b", "c"]
    empty = stats.overview(findings.where("false"), ["path"]).first()
    assert empty.asDict() == {"total": 0, "sensitive": 0, "files": 0, "groups": 0}


@pytest.mark.parametrize("fmt", ["json", "csv"])
@pytest.mark.parametrize("split", [False, True])
def test_sinks_round_trip(spark, tmp_path, findings, fmt, split):
    path = sinks.write(findings, f"{tmp_path}/out.old", fmt, split)
    assert path == f"{tmp_path}/out/format={fmt}"
    back = sinks.read_back(spark, path, findings.schema, fmt)
    assert sorted(back.collect()) == sorted(findings.collect())
    if split:
        part = sinks.read_back(spark, f"{path}/rule_group=G1", findings.schema, fmt)
        assert values(part, "group") == ["G1", "G1"]


def test_empty_output_is_readable(spark, tmp_path, findings):
    path = sinks.write(findings.where("false"), f"{tmp_path}/none", "json")
    assert sinks.read_back(spark, path, findings.schema).count() == 0
    with pytest.raises(ValueError, match="format"):
        sinks.write(findings, f"{tmp_path}/x", "xml")


def test_output_names():
    assert sinks.output_path("/a/b.c/report.v1.json", "csv") == "/a/b.c/report.v1/format=csv"
    assert sinks.output_path("report") == "report/format=json"


def test_results_pipeline(spark, tmp_path, findings):
    output = Output(
        f"{tmp_path}/res",
        fmt="csv",
        split_by_group=True,
        keys=["match", "file"],
        clean=True,
        block=["Test", "'("],
    )
    report = process_results(findings, ["path"], output)
    # Statistics see the findings as they were found.
    assert report.overview.first()["total"] == 4
    assert report.top_rules.first()["rule_name"] == "one"
    schema = findings.select("match", "path", "group").schema
    back = sinks.read_back(spark, report.path, schema, "csv")
    assert values(back, "match") == ["blanks", "quoted / value", "x{y}z"]


def test_rule_report(spark, tmp_path, one_rule):
    rules, summary = rule_report(one_rule("a+", sample_code="aa"), f"{tmp_path}/report")
    assert spark.read.json(rules).first()["status"] == "valid"
    assert spark.read.json(summary).first()["verdict"] == "passed"
