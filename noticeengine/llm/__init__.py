"""Training-data operators: quality, mixing, language, near copies, formatting, secrets, substrings, scoring, leaks."""
