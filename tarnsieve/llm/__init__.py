"""Training-data operators: ten ways to clean, label, mix and lay out a corpus."""
