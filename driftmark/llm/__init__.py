"""Corpus preparation: operators over text collections for model training."""
