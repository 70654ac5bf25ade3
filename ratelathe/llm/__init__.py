"""Training-data operators on text and term collections; nothing else imports this package."""
