"""Readers of chunk corpora, extracted pages, glossaries, manifests and benchmarks; writers of results."""
