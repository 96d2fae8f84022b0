import json

import pytest

from textsentry import RuleError, compile_rules, default_rules, load_rules, select_rules
from textsentry.operators import rules as ruleops
from textsentry.operators.rules import rule_pack
from textsentry.operators.validation import (
    require_valid,
    self_test,
    self_test_summary,
    validate,
    validation_summary,
)
from textsentry.sources.catalogue import require_rules


def rule(name="R", f_regex="abc", **fields):
    return {"name": name, "f_regex": f_regex, "loaded": True, **fields}


def names(df):
    return sorted(r["name"] for r in df.select("name").collect())


def test_yaml_file_folds_lines_and_takes_zero_values(spark, tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "rules.yaml"
    path.write_text(
        "rules:\n  - group: A\n    rule:\n      - name: Folded\n        f_regex: 'one\n          two'\n"
        "      - name: 302\n        f_regex: x\n        loaded: true\n  - group: Empty\n    rule: []\n"
    )
    rows = {r["name"]: r for r in load_rules(spark, str(path)).collect()}
    assert rows["Folded"]["f_regex"] == "one two"
    assert rows["Folded"]["loaded"] is False and rows["Folded"]["engine"] == ""
    assert rows["302"]["loaded"] is True and rows["302"]["rule_ord"] == 1
    assert len(rows) == 2


def test_json_and_parquet_catalogues_agree(spark, tmp_path, make_rules):
    groups = [("A", [rule("X"), rule("Y", sensitive=True)])]
    flat = make_rules(*groups)
    flat.write.parquet(str(tmp_path / "flat.parquet"))
    (tmp_path / "rules.json").write_text(
        json.dumps({"rules": [{"group": g, "rule": rs} for g, rs in groups]})
    )
    want = sorted(flat.collect())
    assert sorted(load_rules(spark, str(tmp_path / "flat.parquet")).collect()) == want
    assert sorted(load_rules(spark, str(tmp_path / "rules.json")).collect()) == want


def test_empty_catalogue_raises(make_rules):
    with pytest.raises(ValueError, match="empty"):
        require_rules(make_rules())


def test_usable_and_filters(make_rules):
    rules = make_rules(
        ("Alpha Group", [rule("Keep"), rule(""), rule("NoRegex", ""), rule("Off", loaded=False)]),
        ("Beta", [rule("Secret", sensitive=True)]),
    )
    assert names(select_rules(rules)) == ["Keep", "Secret"]
    assert names(select_rules(rules, groups=["  ALPHA ", ""])) == ["Keep"]
    assert names(select_rules(rules, names=["eEp", " "])) == ["Keep"]
    assert names(select_rules(rules, groups=[" ", ""], names=[])) == ["Keep", "Secret"]
    assert names(select_rules(rules, only_sensitive=True)) == ["Secret"]


def test_context_defaults(make_rules):
    rules = make_rules(
        (
            "A",
            [
                rule("bare", sensitive=True),
                rule("left", sensitive=True, context_left=10),
                rule("negative", sensitive=True, context_left=-3, context_right=0),
                rule("plain", context_left=0),
            ],
        )
    )
    rows = {r["name"]: (r["context_left"], r["context_right"]) for r in select_rules(rules).collect()}
    assert rows == {"bare": (50, 50), "left": (10, 0), "negative": (50, 50), "plain": (0, 0)}


def test_last_group_wins_among_groups_with_rules_left(make_rules):
    rules = make_rules(
        ("A", [rule("first"), rule("second")]),
        ("A", [rule("third")]),
        ("A", [rule("off", loaded=False)]),
    )
    assert names(select_rules(rules)) == ["third"]
    counted = ruleops.count_rules(select_rules(rules)).first()
    assert (counted["rules"], counted["groups"]) == (1, 1)


def test_listing_cuts_long_patterns(make_rules):
    rules = make_rules(("A", [rule("long", "x" * 51), rule("short", "x" * 50)]))
    lines = {r["name"]: r["line"] for r in ruleops.listing(rules).collect()}
    assert lines["long"] == "A: long: " + "x" * 47 + "..."
    assert lines["short"] == "A: short: " + "x" * 50


def test_engine_resolution(make_rules):
    cases = {
        "nfa": ("a+", "nfa", "java"),
        "dfa": ("a+", "dfa", "java"),
        "java": ("a+", "java", "java"),
        "go": ("a+", "go", "go"),
        "auto": ("a+", "", "go"),
        "lookahead": ("a(?=b)", "", "java"),
        "lookbehind": ("(?<!a)b", "", "java"),
        "backreference": (r"(a)\1", "", "java"),
        "escape": (r"[\u4E00-\u9FFF]", "", "java"),
        "named": ("(?P<n>a)", "", "go"),
        "wrong": ("a", "NFA", None),
    }
    rules = make_rules(("A", [rule(n, p, engine=e) for n, (p, e, _) in cases.items()]))
    rows = {r["name"]: r for r in compile_rules(rules).collect()}
    assert {n: rows[n]["engine_resolved"] for n in cases} == {n: c[2] for n, c in cases.items()}
    assert rows["auto"]["pattern"] == "(?dmiu)a+"
    assert rows["nfa"]["pattern"] == "(?dmiU)a+"


def test_bad_rules_name_the_culprit(make_rules):
    with pytest.raises(RuleError, match=r"engine 'perl' \[A:X\]"):
        rule_pack(compile_rules(make_rules(("A", [rule("X", engine="perl")]))))
    with pytest.raises(RuleError, match=r"compile \[A:X\]"):
        rule_pack(compile_rules(make_rules(("A", [rule("X", "a(b")]))))


def test_validation_and_self_test(make_rules):
    rules = make_rules(
        (
            "A",
            [
                rule("ok", "a+", sample_code="baa"),
                rule("nosample", "a+"),
                rule("case", "ABC", sample_code="abc"),
                rule("broken", "a(b", sample_code="ab"),
                rule("", "a", sample_code="a"),
                rule("noregex", "", sample_code="a"),
                rule("off", "a(", loaded=False),
                rule("conditional", "(a)?(?(1)b|c)", sample_code="ab"),
                rule("quoted", r"(?P<q>['\"])x\k'q'", sample_code="'x'"),
            ],
        )
    )
    status = {r["name"]: r["status"] for r in validate(rules).collect()}
    assert status == {
        "ok": "ok",
        "nosample": "no_sample",
        "case": "sample_mismatch",
        "broken": "compile_error",
        "": "missing_name",
        "noregex": "missing_regex",
        "conditional": "compile_error",
        "quoted": "ok",
    }
    summary = validation_summary(validate(rules)).first()
    assert (summary["checked"], summary["valid"], summary["invalid"]) == (8, 3, 5)
    with pytest.raises(RuleError, match="found 5 invalid rules"):
        require_valid(rules)

    tested = {r["name"]: (r["status"], r["reason"]) for r in self_test(rules).collect()}
    assert tested["case"] == ("compile_error", "sample does not match")
    assert tested["broken"] == ("compile_error", "pattern does not compile")
    assert tested[""] == ("valid", "") and tested["noregex"] == ("valid", "")
    row = self_test_summary(self_test(rules)).first()
    assert (row["total_rules"], row["valid"], row["no_sample"], row["compile_error"]) == (8, 4, 1, 3)
    assert (row["valid_pct"], row["verdict"]) == (50.0, "failed")


def test_self_test_of_nothing(make_rules):
    row = self_test_summary(self_test(make_rules(("A", [rule(loaded=False)])))).first()
    assert (row["total_rules"], row["valid_pct"], row["verdict"]) == (0, None, "passed")


def test_built_in_packs_are_valid(spark):
    rules = default_rules(spark, extended=True)
    assert {r["status"] for r in validate(rules).collect()} == {"ok"}
    assert self_test_summary(self_test(rules)).first()["verdict"] == "passed"
    assert default_rules(spark).count() == 11
    assert len(rule_pack(compile_rules(rules))) == rules.count()
