"""Stochastic block partition: entropy, merges, moves, search, generation and evaluation."""
