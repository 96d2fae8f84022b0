"""End-to-end jobs: scan a tree of files, process and write findings, test rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from textsentry.operators import findings as post
from textsentry.operators import sinks, stats
from textsentry.operators.scan import prepare, scan, scan_large
from textsentry.operators.validation import self_test, self_test_summary
from textsentry.session import materialise, spread
from textsentry.sources import chunks, files


@dataclass(frozen=True)
class Output:
    """What to do with findings. Clean-up is off unless asked for."""

    base: str
    fmt: str = sinks.JSON
    split_by_group: bool = False
    keys: list[str] = field(default_factory=list)
    clean: bool = False
    block: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Report:
    """Statistics of the raw findings and the folder the processed ones went to."""

    overview: DataFrame
    by_group: DataFrame
    top_rules: DataFrame
    path: str


def scan_rows(
    rows: DataFrame,
    rules: DataFrame | list[dict],
    *,
    charsets: tuple[str, ...] = files.DEFAULT_CHARSETS,
    chunk_threshold_mb: float = 0,
    chunk_bytes: int = chunks.CHUNK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Findings and per-file errors of binaryFile rows.

    With ``chunk_threshold_mb`` larger texts are scanned in overlapping chunks,
    which finds the matches of the whole text, at their own places.
    """
    decoded = files.decode_text(rows.select("path", "content"), charsets=charsets)
    texts = files.scannable(decoded)
    if chunk_threshold_mb > 0:
        found = scan_large(texts, rules, ["path"], threshold_mb=chunk_threshold_mb, chunk_bytes=chunk_bytes)
    else:
        found = scan(texts, rules, ["path"])
    return found, files.scan_errors(decoded, ["path"])


def scan_tree(
    spark: SparkSession,
    path: str,
    rules: DataFrame | list[dict],
    *,
    exclude_ext: list[str] | None = None,
    exclude_path: list[str] | None = None,
    limit_mb: float = 0,
    chunk_threshold_mb: float = 0,
    charsets: tuple[str, ...] = files.DEFAULT_CHARSETS,
) -> tuple[DataFrame, DataFrame]:
    """Findings and errors of all files below ``path``; a file above the size limit or without content is an error."""
    chosen = {"exclude_ext": exclude_ext, "exclude_path": exclude_path}
    rows = files.read_files(spark, path, limit_mb=limit_mb, **chosen)
    unread = files.listing_errors(spark, path, **chosen)
    files.require_files(rows.select("path").unionByName(unread.select("path")))
    found, errors = scan_rows(rows, rules, charsets=charsets, chunk_threshold_mb=chunk_threshold_mb)
    errors = errors.unionByName(unread)
    if limit_mb > 0:
        listed = files.read_files(spark, path, limit_mb=0, **chosen)
        errors = errors.unionByName(files.size_errors(listed, ["path"], limit_mb))
    return found, errors


def process_results(found: DataFrame, id_cols: list[str], output: Output) -> Report:
    """Statistics on raw findings, then clean-up, blocklist, keys and the sink, in this order.

    The findings are written once and both halves read that table.
    """
    raw = materialise(found.hint("rebalance"), "findings")
    out = post.clean(raw, id_cols) if output.clean else raw
    out = post.block(out, output.block)
    split = output.split_by_group
    if output.keys:
        chosen = post.select_keys(out, output.keys, id_cols).columns
        out = out.select(*chosen) if not split or "group" in chosen else out.select(*chosen, "group")
    path = sinks.write(out, output.base, output.fmt, split)
    return Report(
        overview=stats.overview(raw, id_cols),
        by_group=stats.by_group(raw),
        top_rules=stats.top_rules(raw),
        path=path,
    )


def scan_table(
    texts: DataFrame,
    rules: DataFrame | list[dict],
    id_cols: list[str],
    text_col: str = "text",
    **choice,
) -> DataFrame:
    """Scan a table with the rules ``choice`` selects, spread over the cluster if it is small."""
    pack = rules if isinstance(rules, list) else prepare(rules, **choice)
    return scan(spread(texts.select(*id_cols, text_col)), pack, id_cols, text_col)


def rule_report(rules: DataFrame, base: str, fmt: str = sinks.JSON) -> tuple[str, str]:
    """Write the self-test as two tables, one row per rule and one summary row."""
    tested = materialise(self_test(rules), "selftest")
    return (
        sinks.write(tested, f"{base}/rules", fmt),
        sinks.write(self_test_summary(tested), f"{base}/summary", fmt),
    )
