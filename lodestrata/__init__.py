"""Spark-native analytics for tracked scene objects, their geometry and their relation graphs."""
