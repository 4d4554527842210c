"""Plans that combine operators: the document model and the formatter."""
