"""Operators for training data drawn from source code and text."""
