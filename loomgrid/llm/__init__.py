"""Training-data operators: packing, token counts, extraction, privacy, dedup, mixing, licences, quality."""
