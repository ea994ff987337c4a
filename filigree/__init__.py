"""Filigree: DataFrame-to-DataFrame operators for disclosure corpora on Spark."""
