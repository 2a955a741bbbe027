"""Training-data operators and their registered queries; nothing outside this subpackage imports it."""
