"""DataFrame-to-DataFrame operators: rules, scan, findings, statistics, sinks."""
