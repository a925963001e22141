"""Per-file extractors: the one place where Python code runs on executors.  Target code is parsed, never imported or run."""
