"""DataFrame operators. Import the sub-modules directly:
clauses, answers, model_stage, hygiene, classify, metrics, agreement, reporting."""
