"""Find sensitive information in tables of text with rules kept as data."""

from textsentry.operators.rules import RuleError, compile_rules, select_rules
from textsentry.operators.scan import prepare, scan, scan_large
from textsentry.operators.sqlfunction import register_scan
from textsentry.operators.validation import require_valid, self_test, validate
from textsentry.plans.pipeline import (
    Output,
    Report,
    process_results,
    rule_report,
    scan_rows,
    scan_table,
    scan_tree,
)
from textsentry.sources.catalogue import load_rules
from textsentry.sources.packs import default_rules
from textsentry.streaming.incremental import resume_files, resume_scan, stream_scan

__all__ = [
    "Output",
    "Report",
    "RuleError",
    "compile_rules",
    "default_rules",
    "load_rules",
    "prepare",
    "process_results",
    "register_scan",
    "require_valid",
    "resume_files",
    "resume_scan",
    "rule_report",
    "scan",
    "scan_large",
    "scan_rows",
    "scan_table",
    "scan_tree",
    "select_rules",
    "self_test",
    "stream_scan",
    "validate",
]
