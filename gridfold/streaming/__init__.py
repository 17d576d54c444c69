"""Incremental composites with Structured Streaming.

The reference processes new composite dates incrementally by skipping tile
products that already exist.  Here the file source's checkpoint plays that
role: each new ``date=`` folder of a cell store is read exactly once, and a
stateful aggregate keeps the running per-cell reduction.
"""

from gridfold.streaming.incremental import (composite_stream, read_running,  # noqa: F401
                                            start_running_temporal)
