"""Operators for preparing text corpora: near duplicates, canonical values, tokens, mixtures, look-alikes."""
