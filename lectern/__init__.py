"""Lectern: document retrieval and exam analytics expressed as Spark plans."""
