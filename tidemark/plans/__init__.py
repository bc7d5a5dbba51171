"""Whole flows: the shared mart, the extract catalogue and materialised steps."""
