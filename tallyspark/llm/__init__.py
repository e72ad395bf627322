"""Training-data operators: search, tokens, deduplication, language, scoring, privacy, licences, decontamination."""
