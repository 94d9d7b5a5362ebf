"""Training-data pipeline operators and their queries; nothing else imports this package."""
