"""Training-data operators: packing, deduplication, encoding, fingerprints, language, media, scoring and mixing."""
