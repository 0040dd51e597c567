"""Training-data pipeline operators (license scans, quality models, WARC
transactions, near-duplicates, decontamination, token files, mixing, URL
filters).  Nothing outside this subpackage and ``corpus_pipeline`` imports it.
"""
