"""Training-data operators: decontamination, near-dedup, BPE, chat, WARC, quality, sharding, HTML, substring dedup, ANN.

Nothing outside this subpackage imports it.
"""
