"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it.  ``queries`` registers one query per
operator; each operator module holds the general interface.
"""
