"""A PySpark-native engine for trimming, filtering, deduplicating and scoring sequencing reads."""
