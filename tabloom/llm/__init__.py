"""Operators for preparing language-model training text.

Nothing outside this package imports it. Each module holds one operator; `queries` applies
them to the test tables. Operators read only the columns they are told to (an id and a text),
so other columns of the input, whatever their names, neither clash nor reach the result.
"""
