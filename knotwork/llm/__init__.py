"""Training-data operators: extraction, near duplicates, language, quality, toxicity, tokens, search."""
