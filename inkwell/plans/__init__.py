"""Whole queries: from documents to findings, reports, fixes and scores."""
