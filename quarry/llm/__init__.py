"""Operators of a training-data pipeline, one module per operator.

``queries.py`` registers one query per operator; nothing outside this
subpackage imports it.
"""
