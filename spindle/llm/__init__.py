"""Training-data operators: token counts, scans, joins, indexes and scoring over whole corpora."""
