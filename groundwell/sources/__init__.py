"""Tables, declared keys, generated data and result files."""
