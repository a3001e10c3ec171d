"""Wearable biosignal features and model evaluation as PySpark DataFrame operators."""
