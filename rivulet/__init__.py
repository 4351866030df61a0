"""A PySpark-native engine for filing resolution and document preparation."""
