"""Training-data operators.

Nothing outside this subpackage imports it.  Each module holds one operator with
its own general interface; `queries` registers one thin query per operator.
"""
