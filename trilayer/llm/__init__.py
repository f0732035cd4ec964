"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  Each module is one operator with
its own general interface; ``queries`` holds the thin registered queries and
``oracle`` their SQL.
"""
