"""Reading exports, transcripts and datasets; writing the result tables."""
