"""Incremental forms: chunk files that arrive are upserted; token streams are summarised."""
