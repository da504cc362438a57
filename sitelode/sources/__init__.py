"""Readers and adapters that give tables the shape operators expect."""
