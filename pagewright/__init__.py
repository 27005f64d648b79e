"""A PySpark-native engine that turns collections of paginated documents into clean Markdown."""
