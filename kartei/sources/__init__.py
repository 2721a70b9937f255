"""Where files, texts and rules come from."""
