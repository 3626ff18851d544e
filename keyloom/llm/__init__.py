"""Operators for preparing large text collections.

The rest of the package doesn't import this subpackage. Each module holds one operator, `common` what they share, and
`queries` the registered queries with their SQL.
"""
