"""Row-local cleaning and scoring on streams."""
