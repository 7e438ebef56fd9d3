"""See README.md for what lives here."""
