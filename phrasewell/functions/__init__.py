"""Column functions: analysis, stemming, scoring."""
