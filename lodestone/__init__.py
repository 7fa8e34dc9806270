"""Spark-native corpus retrieval, decision mining and corpus-health analytics.

Operators take DataFrames in and return DataFrames; see README.md for the layout.
"""

from lodestone.session import build_session, scratch_path, small_enough

__all__ = ["build_session", "scratch_path", "small_enough"]
