"""Training-data operators: fingerprints, decontamination, chat formatting, classifiers, token files, BPE, WARC.

Nothing outside this subpackage imports it.
"""
