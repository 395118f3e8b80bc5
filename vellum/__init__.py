"""Vellum: finding, normalising and expanding abbreviations in early printed texts, on Spark."""
