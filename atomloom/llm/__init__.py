"""Training-data pipeline operators (sharding, language ID, quality, dedup, tokens, archives).

Nothing else in the library imports this subpackage.
"""
