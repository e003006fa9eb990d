"""Vector search, keyed document stores and document analytics as DataFrame-to-DataFrame operators."""
