"""What to start, repair or retire, as relations."""
