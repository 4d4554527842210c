"""The linter: rules are names with builders of findings over the document model; policy, fixes and reports."""
