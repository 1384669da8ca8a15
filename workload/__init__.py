"""The registered queries, their input views over the driver tables and their oracle SQL."""
