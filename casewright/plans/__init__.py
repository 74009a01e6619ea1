"""The registered queries: importing the package registers all of them."""

from casewright.plans import archives, desk, features, prompts, queries, records, replies, texts

__all__ = ["desk", "features", "queries", "records", "replies", "texts"]
