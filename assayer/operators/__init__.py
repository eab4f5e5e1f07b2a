"""DataFrame operators: clauses, rules, joins, retrieval, model, quality."""
