"""Scalar functions of the engine as column expressions, and the id codecs."""
