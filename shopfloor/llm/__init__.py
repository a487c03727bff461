"""Training-data operators: deduplication, decontamination, redaction, scoring and mixing of text corpora."""
