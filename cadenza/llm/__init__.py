"""Operators of a training-data pipeline over tables of documents and pages.

quality_classifier  Bradley-Terry scores learned from preference pairs
suffix_dedup        repeated 200-byte strings by two-stage suffix sorting
url_filter          block and allow rules spread over redirect equivalence
license_scan        licence statements by Dice coefficient over word bigrams
secret_scan         secrets behind a trigram inverted index
pii                 personal data, also disguised, with source offsets
decontaminate       benchmark leaks by template windows and slot consistency
simhash             near copies by SimHash and a Gray-order index
host_rules          text quality rules shrunk per host
mixing              entropy balancing of sources to target weights
lexical_search      ranked search, pruned by hashed max-sketches
language_id         averaged subword embeddings with a linear softmax
prefix_trie         conversation prefixes in minimal-perfect-hash slots

Every operator selects the columns it needs first, so further columns of its
input, whatever their names, never clash with its own.
"""
