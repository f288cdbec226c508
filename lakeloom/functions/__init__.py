"""Part of lakeloom; see README.md."""
