"""Readers, writers and the projection of warehouse tables onto the book model."""
