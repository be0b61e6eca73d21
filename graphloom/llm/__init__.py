"""Training-data operators: tokens, chat, scoring, scans, language, dedup, mixing.

Nothing outside this subpackage imports it.
"""
