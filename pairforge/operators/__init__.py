"""DataFrame-to-DataFrame operators, lazy but for two documented spots.

``skew.hot_keys`` reads a short list of at most 512 keys, and
``evaluate.spearman`` writes its collapsed cells and their buckets once.
"""
