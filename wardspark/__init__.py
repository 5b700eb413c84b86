"""wardspark: code-security findings analytics as declarative Spark plans."""
