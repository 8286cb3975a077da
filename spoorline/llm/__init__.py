"""Training-data operators: ten corpus operators that share nothing with the rest of the library."""
