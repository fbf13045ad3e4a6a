"""Operators of a training-data pipeline: tokenisation, decontamination,
personal data, quality, near-duplicates, URLs, secrets, language-model
scores, token files and exact search. Nothing outside this subpackage
imports it."""
