"""Operators for large text corpora; nothing else in the package imports this folder.

Executors import these modules (numpy, pyarrow, pyahocorasick and regex with
them), so the package is installed there or shipped with ``--py-files``.
"""
