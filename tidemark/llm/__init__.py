"""Operations of a training-data pipeline: mixing, deduplication, extraction, quality, tokens, language, toxicity.

Nothing else in the library imports this subpackage.
"""
