"""Spark-native operators for financial tables, document corpora and evaluation logs."""

from quarry.session import build_session, configure, scratch_path

__all__ = ["build_session", "configure", "scratch_path"]
