"""Operators for preparing training corpora: deduplication, quality, packing, token counts, sharding."""
