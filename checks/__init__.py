"""Checks that run the operators over the given tables, with an SQL form where there is one."""
