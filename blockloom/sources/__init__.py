"""Where image bytes come from."""
