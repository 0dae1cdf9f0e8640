"""Binary and text formats of indexes, query batches and word streams, as Spark data sources."""

from postlane.sources.formats import numbered, read_index, read_queries, read_words, register, stream_offsets, write_index, write_queries, write_words

__all__ = ["numbered", "read_index", "read_queries", "read_words", "register", "stream_offsets", "write_index", "write_queries", "write_words"]
