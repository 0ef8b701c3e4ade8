"""Reading, writing, adapting and generating the canonical tables."""
