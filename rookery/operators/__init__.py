"""DataFrame-in, DataFrame-out operators over whole tables."""
