"""Composed jobs: corpus build, retrieval, evaluation, prompt assembly."""
