"""Operators a training-data pipeline needs: duplicates, tokens, packing, filters, search and mixing."""
