"""Live ad clicks: each pipeline ends in the same rows as its batch counterpart."""
