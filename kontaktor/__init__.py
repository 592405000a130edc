"""kontaktor: contact analytics over stored pages and search results, on Spark."""
