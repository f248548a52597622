"""pathloom: radio-multipath and fingerprint analytics as Spark DataFrame jobs."""
