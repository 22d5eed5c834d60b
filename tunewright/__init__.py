"""Recommendation and text-retrieval analytics on PySpark DataFrames.

Every operator takes and returns DataFrames keyed by ``user_id`` and/or
``song_id`` and answers for all users in one batch job.
"""
