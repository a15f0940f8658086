"""Writers for articles and failures."""
