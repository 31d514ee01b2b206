"""DataFrame operators: retrieval, features, labels, feedback, ranking, metrics, shortlists and reports."""
