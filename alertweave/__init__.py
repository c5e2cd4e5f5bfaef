"""Alert triage as Spark tables: sources, operators, sinks and whole-run plans."""
