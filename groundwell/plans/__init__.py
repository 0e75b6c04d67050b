"""From a question or a statement to checked, bounded, comparable results."""
