"""Operators for large text corpora: filters, near duplicates, decontamination, redaction and packing."""
