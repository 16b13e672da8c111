"""Composed jobs: the batch run and the streaming run."""
