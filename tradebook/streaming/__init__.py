from tradebook.streaming.change_stream import stream_changes

__all__ = ["stream_changes"]
