"""Operators for preparing large training corpora.

Each module holds one operator with a general interface; :mod:`obsidra.llm.queries`
registers one production query per operator.
"""
