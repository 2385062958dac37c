"""Relational operators of the defect pipeline, as DataFrame functions."""
