"""Operators for training data at corpus scale, one module each; ``queries`` registers them."""
