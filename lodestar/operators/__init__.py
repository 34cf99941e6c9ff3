"""Relational operators over a corpus: search, outlines, containment, look-up, roll-ups, views, changes, traces."""
