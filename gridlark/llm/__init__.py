"""Operators for training-corpus pipelines. Nothing else in the package imports this subpackage."""
