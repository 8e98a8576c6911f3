"""Driver-side planning of detection rules: JSON trees become Spark columns."""
