"""Functions on values: ``text`` for columns, ``lines`` for folds inside Arrow UDFs."""
