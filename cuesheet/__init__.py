"""cuesheet: timed-transcript and scene analytics as Spark DataFrame jobs.

Captions become speaker turns, turns become size-bounded batches, extractor
responses become validated scene rows, captions are aligned with scenes, and
playback positions are resolved to scenes (batch and Structured Streaming).
Training-data preparation (indexing, pairing, top-up, batching, retention) is
expressed over tables as well.
"""

from cuesheet.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
