import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("work")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_rules(spark):
    """Rules from ``(group, [rule, ...])`` pairs; rules are dicts of rule-file keys."""
    from textsentry.sources.catalogue import catalogue_frame, flatten_catalogue

    def make(*groups):
        document = {"rules": [{"group": g, "rule": rules} for g, rules in groups]}
        return flatten_catalogue(catalogue_frame(spark, document))

    return make


@pytest.fixture(scope="session")
def one_rule(make_rules):
    def make(pattern, **fields):
        rule = {"name": "R", "f_regex": pattern, "loaded": True, "engine": "nfa", **fields}
        return make_rules(("G", [rule]))

    return make


@pytest.fixture(scope="session")
def texts(spark):
    def make(*values):
        return spark.createDataFrame(list(enumerate(values)), "id long, text string")

    return make
