"""patternlake: mining and scoring co-occurrence patterns in sensor streams and transaction tables, on Spark."""
