"""Progressive refinement of level-of-detail ladders as Structured Streaming."""
