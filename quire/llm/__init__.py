"""Training-data operators. Nothing outside this subpackage imports it; corpus_pipeline.py strings its stages together."""
