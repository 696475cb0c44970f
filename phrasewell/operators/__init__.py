"""Query operators over index tables: expansion, intersection, phrase matching."""
