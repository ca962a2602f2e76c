"""Training-data operators: quality classifier, language-model scoring, secret
scans, WARC archives, near-duplicate detection, URL filters, benchmark
decontamination, sequence packing, exact top-k search and repeated-unit removal.

Nothing else in the library imports this package.  Each module holds one
operator with a general interface; ``queries`` registers the checked queries.
"""
