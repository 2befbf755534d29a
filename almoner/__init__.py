"""Fundraising analytics on Spark: reports over donors, gifts and calls, and
the table jobs that feed them. Everything is lazy DataFrame code unless a
docstring says it runs a job."""

from almoner.model import TABLES, Tables

__all__ = ["TABLES", "Tables"]
