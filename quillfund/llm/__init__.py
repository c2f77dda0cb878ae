"""Training-data operators: dedup, decontamination, PII, classifiers, WARC and tokenisation."""
