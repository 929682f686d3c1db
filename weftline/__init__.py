"""Typed object graphs over Spark tables: nested shapes, links, policies, functions and changes as DataFrame plans."""
