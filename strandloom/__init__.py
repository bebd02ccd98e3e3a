"""strandloom: timed-text and structured-document analytics as Spark DataFrame operators."""
