"""Catalogue analytics for hierarchical imaging metadata, as Spark jobs."""
