"""A PySpark-native engine for root-cause evidence over wide, missing-heavy measurements."""
