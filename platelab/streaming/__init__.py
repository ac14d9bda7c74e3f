"""Incremental work. Batch appends by missing key are the reference behaviour; streams are an extension."""
