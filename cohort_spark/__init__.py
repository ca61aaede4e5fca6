"""PySpark operators for a multimodal cohort registry and for training-data preparation."""
