"""Training-data operators: duplicates, extraction, quality, language, licences, mixing and packing."""
