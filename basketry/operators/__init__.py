"""Analytical jobs: ``job(views, **params) -> DataFrame``, all lazy."""
