"""Writers: append, replace, idempotent upsert and rendered results."""
