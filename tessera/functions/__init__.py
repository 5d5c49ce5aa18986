"""See README.md for what this part holds."""
