"""Readers and writers of the engine's inputs and results."""
