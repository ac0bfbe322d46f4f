"""Training-data operators: media columns, language ID, BPE, packing, quality, chat, WARC, near copies, secrets.

Nothing else in the library imports this package.
"""
