"""Multi-operator plans: whole-repository analysis, highlights and reports."""
