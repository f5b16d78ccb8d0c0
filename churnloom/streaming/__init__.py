"""Row-local stages on streams, with parameters fitted on a batch."""

from churnloom.streaming.enrich import enrich_stream

__all__ = ["enrich_stream"]
