"""DataFrame operators on page facts, page state and page text."""
