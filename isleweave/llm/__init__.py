"""Operators on text for training language models; nothing outside this subpackage imports it."""
