"""Operators that clean, deduplicate, mix and encode text corpora; nothing else in the library imports them."""
