"""Where texts come from: directory trees, tables, decoding, languages."""
