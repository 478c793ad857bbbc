"""Numpy kernels that run inside Arrow functions."""
