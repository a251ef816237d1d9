"""Named queries over the star-schema tables, each with an independent SQL check."""
