"""Operators that a training-data pipeline needs, over ``documents``, ``labels``, ``embeddings`` and ``benchmark``."""
