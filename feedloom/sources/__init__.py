"""From landed text to typed rows.

Parsers keep every line and add ``reason``: null for a good row, else why it was refused.
``good`` and ``rejects`` divide them.
"""
