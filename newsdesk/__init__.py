"""newsdesk: a PySpark-native content-refinement and feed analytics engine."""
