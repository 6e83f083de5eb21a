"""Lodestone: archive, asset and corpus analytics as Spark jobs."""
