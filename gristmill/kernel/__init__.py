"""Per-text algorithms in plain Python; no Spark here."""
