"""Micro-batch form of the page job."""
