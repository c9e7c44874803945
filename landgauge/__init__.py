"""Spark-native land and place appraisal: operators, sources and marts on DataFrames."""
