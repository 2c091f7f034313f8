"""Column functions: text analysis, stemming, vector metrics, coercion and JSON."""
