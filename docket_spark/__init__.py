"""PySpark-native event-history analytics and scoring."""
