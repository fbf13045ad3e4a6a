"""Incremental counting with Structured Streaming.

incremental behaviour is re-running what is missing. Counting (A1/A2) is a
plain aggregation, so the same token expressions run unchanged on a stream
of newly arriving document files: ``stream_counts`` keeps running n-gram
counts per corpus in ``complete``/``update`` mode, with the state store
checkpointed in the session's checkpoint folder (so a lost executor or a
restarted query resumes from the last committed batch).
"""

from corpusdelta.streaming.counts import stream_counts  # noqa: F401
