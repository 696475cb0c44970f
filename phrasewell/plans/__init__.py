"""Query language and query plans."""
