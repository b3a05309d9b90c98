"""Training-data operators: language ID, near-duplicates, secrets, PII,
tokenizer coding, token files, packing, quality rules and classifiers."""
